import hashlib

import pytest
from pyspark.sql import functions as F

from trailhead.llm import manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
KIND = "doc_id long, source string, lang string, n_chars long, text string, g string, pos int, n string, digest string, grp int, path int, rid string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, arity):
    """All levels of the tree over nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def brute(rows, arity):
    """Sorted (leaf, subroot, root, siblings) of rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in keys:
        leaves = sorted((r[0] is not None, r[0] or 0, h(*map(framed, r[:5]))) for r in groups[s])
        trees[s] = climb([x[2] for x in leaves], arity)
    top = climb([trees[s][-1][0] for s in keys], arity)
    out = []
    for k, s in enumerate(keys):
        for i, leaf in enumerate(trees[s][0]):
            sibs = []
            for levels, at in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    lo = at // arity * arity
                    sibs += [x for j, x in enumerate(level[lo : lo + arity], lo) if j != at]
                    at //= arity
            out.append((leaf, trees[s][-1][0], top[-1][0], "".join(sibs)))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y", "z", 1, 2, "w") for r in rows], KIND)


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_is_the_plain_tree_s(spark, arity):
    rows = [(i, f"s{i % 4}" if i % 4 else None, "de", i, f"text {i}\nline") for i in range(60)]
    rows += [(100, "lone", None, None, None), (None, "s1", "en", 1, ""), (None, None, None, None, None), (7, "s3", "de", 7, "other text"), (5, "s1", "de", 5, "text 5\nline"), (5, "s1", "de", 5, "text 5\nline")]
    rows += [(200 + i, "é", "fr", 1, "same") for i in range(9)] + [(300, "", "fr", 1, "x" * 200_000), (301, "a-", "-", 0, "1:-")]
    m = manifest.build(table(spark, rows), COLUMNS, "source", "doc_id", {"doc_id": F.col("doc_id"), "digest": F.col("digest")}, arity)
    got = manifest.proofs(m).select("leaf", "subroot", manifest.siblings(F.col("path")), manifest.fold(F.col("leaf"), F.col("path")), "digest").collect()
    assert sorted((r[0], r[1], m.root, r[2]) for r in got) == brute(rows, arity)
    assert {r[3] for r in got} == {m.root} and {r["digest"] for r in got} == {"z"}
    with pytest.raises(ValueError):
        manifest.build(table(spark, rows), COLUMNS, "source", "doc_id", {"leaf": F.col("doc_id")})


def test_empty_and_single(spark):
    m = manifest.build(table(spark, []), COLUMNS, "source", "doc_id")
    assert m.root is None and manifest.proofs(m).collect() == []
    m = manifest.build(table(spark, [(1, None, None, None, None)]), COLUMNS, "source", "doc_id")
    one = manifest.proofs(m).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == m.root == h("1:1", "-", "-", "-", "-") and one[0]["path"] == []


def test_tampering_shows(spark):
    rows = [(i, "s", "de", i, f"a\n{i}") for i in range(20)]
    docs = table(spark, rows)
    seen = manifest.leaf(*[F.col(c) for c in COLUMNS[:4]], F.when(F.col("doc_id") == 11, F.lit("a11")).otherwise(F.col("text")))
    m = manifest.build(docs, COLUMNS, "source", "doc_id", {"doc_id": F.col("doc_id"), "seen": seen})
    bad = manifest.proofs(m).where(manifest.fold(F.col("seen"), F.col("path")) != m.root).collect()
    assert [r["doc_id"] for r in bad] == [11]
