"""BM25 by scan: what leaves the one pass over the chunks are the hits."""

from trailhead.operators import fts


def test_only_hits_leave_the_scan(spark, monkeypatch):
    made, write = {}, fts.written

    def kept(df, name):
        made[name] = write(df, name)
        return made[name]

    monkeypatch.setattr(fts, "written", kept)
    chunks = spark.createDataFrame([("a", "connected things"), ("b", "connection and connections"), ("c", "other words"), ("d", "")], "chunk_id string, content string")
    q = spark.createDataFrame([(1, ["connecting"]), (2, ["absent"])], "query_id long, terms array<string>")
    for stem, found in ((True, {"a", "b"}), (False, set())):
        assert {x["chunk_id"] for x in fts.bm25(chunks, q, stem=stem).collect()} == found
        assert made["hits"].written_rows == len(found)
    assert fts.bm25(chunks.limit(0), q).count() == 0
