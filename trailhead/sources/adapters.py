"""Domain tables derived from the star-schema, document and event tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailhead.functions import text as X
from trailhead.operators.chunking import line_chunks
from trailhead.operators.text_index import TextIndex
from trailhead.schemas import INTENT_KINDS, INTENT_STATUSES
from trailhead.sources.snapshots import scratch_table

#: Folders of the indexes that this process has built, by application, data folder and stemming.
_INDEXES: dict[tuple, str] = {}


def epoch(ts: str) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone, whatever the session's time zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def _pick(key: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))


class Tables:
    """Domain tables of one data folder; each is a lazy DataFrame, so plans prune columns and rows down to the files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def streamed(self) -> Tables:
        """The same tables as streams of their files, a file or more a batch."""
        return _Streamed(self.spark, self.sf_dir)

    def tool_events(self) -> DataFrame:
        e = self.raw("events")
        k = F.get_json_object("props", "$.k").cast("int")
        lane = _pick(F.col("user_id") % 3, ("cli", "mcp", "progressive_mcp"))
        return e.select(
            F.col("event_id").alias("id"), F.concat(F.lit("s"), "user_id").alias("session_id"), F.col("event_type").alias("tool"), F.col("props").alias("query"),
            F.concat(F.lit("strategy="), "event_type", F.lit(";lane="), lane, F.lit(";outcome="), F.when(F.col("event_type") == "error", "failed").otherwise("ok")).alias("strategy"),
            k.alias("result_count"), F.floor(F.col("value") * 10).alias("latency_ms"), F.when(F.col("event_type") != "error", k / F.lit(100.0)).alias("groundedness_score"),
            epoch("ts").alias("created_at"), F.when(F.col("event_id") % 9 == 0, "  ").otherwise(F.concat(F.lit("wt-"), F.col("event_id") % 4)).alias("worktree_id"),
        )

    def chunk_access(self) -> DataFrame:
        return self.tool_events().select("id", F.concat(F.lit("src/f"), "result_count", F.lit(".rs")).alias("file_path"), "session_id", "worktree_id", F.col("created_at").alias("accessed_at"))

    def document_access(self) -> DataFrame:
        """Accesses to document files: an event's k names the document."""
        a = self.tool_events().select(F.col("result_count").cast("long").alias("doc_id"), "session_id", F.col("created_at").alias("accessed_at"))
        return a.join(self.files().select("doc_id", "file_path"), "doc_id").select("file_path", "session_id", "accessed_at")

    def result_sets(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("file_id"))

    def files(self) -> DataFrame:
        d = self.raw("documents")
        path = F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), "doc_id", F.lit(".txt")))
        return d.select("doc_id", path.alias("file_path"), F.col("lang").alias("language"), F.col("text").alias("content"), "source")

    def file_meta(self) -> DataFrame:
        """The index's snapshot: files of source src3 aren't in it yet, French ones had other contents."""
        f = self.files().where("source <> 'src3'")
        return f.select("file_path", F.sha2(F.when(F.col("language") == "fr", F.concat("content", F.lit("#"))).otherwise(F.col("content")), 256).alias("content_hash"))

    def current_files(self) -> DataFrame:
        """The tree's snapshot: files of source src5 are gone."""
        return self.files().where("source <> 'src5'").select("file_path", F.sha2("content", 256).alias("content_hash"))

    @staticmethod
    def chunks_of(files: DataFrame) -> DataFrame:
        c = line_chunks(files, "content", 50)
        c = c.withColumn("symbol_name", F.concat_ws("_", "language", (F.col("start_line") / 50).cast("int")))
        return c.withColumn("chunk_id", F.concat_ws(":", "file_path", "start_line", "end_line", F.md5(F.col("content").cast("binary"))))

    def chunks(self) -> DataFrame:
        return self.chunks_of(self.files())

    def hashed_files(self) -> DataFrame:
        return self.files().withColumn("content_hash", F.sha2("content", 256))

    def index(self, stem: bool = False) -> TextIndex:
        """The folder's stored index, which the first search of an application builds."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, stem)
        if key not in _INDEXES:
            index = TextIndex(self.spark, scratch_table(self.spark, "index"), stem=stem)
            index.build(self.hashed_files(), self.chunks_of)
            _INDEXES[key] = index.path
        return TextIndex(self.spark, _INDEXES[key], stem=stem)

    def query_strings(self) -> DataFrame:
        """A search string of a benchmark item, by its number: a phrase, terms with AND, OR and NOT, a prefix, and mixtures with columns."""
        q = self.search_queries().select("query_id", "terms", X.index_tokens(F.col("text")).alias("w"))
        quoted = lambda words: F.concat(F.lit('"'), F.array_join(words, " "), F.lit('"'))
        t = [F.col("terms")[i] for i in range(3)]
        k = F.col("query_id") % 6
        text = F.when(k == 0, quoted(F.expr("slice(w, 1 + cast(query_id % 5 as int), 3 + cast(query_id % 3 as int))"))).when(k == 1, F.concat(t[0], F.lit(" AND "), t[1]))
        text = text.when(k == 2, F.concat(F.lit("("), t[0], F.lit(" OR "), t[1], F.lit(") NOT "), t[2])).when(k == 3, F.concat(F.substring(t[0], F.lit(1), (3 + F.col("query_id") % 6).cast("int")), F.lit("*")))
        text = text.when(k == 4, F.concat(F.lit("content:"), quoted(F.slice("w", 1, 2)), F.lit(" "), F.col("w")[4], F.lit("*"))).otherwise(F.concat(F.lit("file_path:en "), t[0]))
        return q.select("query_id", text.alias("query"))

    def search_queries(self) -> DataFrame:
        """A query per benchmark item: its three longest words, alphabetically among equals."""
        t = F.transform(F.array_distinct(X.index_tokens(F.col("text"))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
        return self.raw("benchmark").select(F.col("item_id").alias("query_id"), F.transform(F.slice(F.array_sort(t), 1, 3), lambda s: s["w"]).alias("terms"), "text")

    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("language"))

    def qa_pairs(self) -> DataFrame:
        c = self.raw("conversations")
        q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
        a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
        return q.join(a, ["conv_id", "turn"])

    def intents(self) -> DataFrame:
        o = self.raw("orders")
        pri = F.substring("o_orderpriority", 1, 1)
        return o.select(
            F.col("o_orderkey").alias("num"), F.concat(F.lit("i"), "o_orderkey").alias("id"), _pick(F.col("o_orderkey") % 6, INTENT_KINDS).alias("kind"), F.concat(F.lit("Intent "), "o_orderkey").alias("title"),
            _pick(F.col("o_custkey") % 8, INTENT_STATUSES).alias("status"), F.when(pri == "1", "critical").when(pri == "2", "high").when(pri == "3", "medium").otherwise("low").alias("priority"),
            F.when(F.col("o_custkey") % 5 != 0, F.concat(F.lit("a"), F.col("o_custkey") % 7)).alias("assigned_to"), epoch("o_orderdate").alias("updated_at"),
        )

    def intent_edges(self) -> DataFrame:
        o = self.raw("orders").select(F.col("o_orderkey").alias("i"))
        two = o.where("i >= 1").select("i", F.expr("i div 2").alias("j"))
        three = o.where("i >= 3").select("i", F.expr("i div 3").alias("j"))
        e = two.union(three).where("i <> j").distinct()
        return e.select(F.concat(F.lit("i"), "i").alias("from_id"), F.concat(F.lit("i"), "j").alias("to_id"), F.when(F.col("i") % 11 == 0, "related_to").otherwise("depends_on").alias("kind"))

    def cyclic_edges(self) -> DataFrame:
        """A functional graph over all orders: i to (i * i + 1) modulo their number."""
        o = self.raw("orders").select(F.col("o_orderkey").alias("i"))
        n = o.agg(F.count(F.lit(1)).alias("n"))
        return o.crossJoin(F.broadcast(n)).select(F.col("i").alias("from_id"), ((F.col("i") * F.col("i") + 1) % F.col("n")).alias("to_id"))  # n is one row

    def looped_edges(self) -> DataFrame:
        """The intents' edges, and back from some targets, which makes cycles of several sizes."""
        e = self.intent_edges().withColumns({c: F.expr(f"cast(substring({c}, 2) as int)") for c in ("from_id", "to_id")})
        back = e.where("from_id % 97 = 0").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.lit("depends_on").alias("kind"))
        return e.union(back).select(F.concat(F.lit("i"), "from_id").alias("from_id"), F.concat(F.lit("i"), "to_id").alias("to_id"), "kind")

    def transition_requests(self) -> DataFrame:
        return self.intents().select("id", F.col("status").alias("current"), _pick(F.col("num") % 8, INTENT_STATUSES).alias("requested"))

    def lock_requests(self) -> DataFrame:
        return self.tool_events().select("id", F.concat(F.lit("i"), "result_count").alias("intent_id"), F.substring("session_id", 2, 20).cast("long").alias("holder"), "worktree_id", F.when(F.col("id") % 5 == 0, "release").otherwise("acquire").alias("action"), F.col("created_at").alias("ts"))

    def eval_runs(self) -> DataFrame:
        e = self.raw("events").select(F.col("event_type").alias("golden_set"), F.date_trunc("day", "ts").alias("day"), "value")
        r = e.groupBy("golden_set", "day").agg(F.round(F.sum(F.round(F.least("value", F.lit(100.0)) * 100).cast("long")) / (F.count(F.lit(1)) * F.lit(10000.0)), 6).alias("overall_score"))
        return r.select(F.concat_ws("-", "golden_set", F.date_format("day", "yyyyMMdd")).alias("id"), "golden_set", "overall_score", (F.col("overall_score") >= 0.45).alias("passed"), epoch("day").alias("created_at"))

    def golden_checks(self) -> DataFrame:
        from trailhead.plans.fixtures import GOLDEN_CHECKS

        return self.spark.createDataFrame(GOLDEN_CHECKS, "case_id string, priority string, kind string, literal string, include string, exclude string")

    def manifests(self) -> DataFrame:
        return self.raw("part").select(F.concat("p_name", F.lit("#"), "p_size").alias("dep"), F.col("p_brand").alias("version"), F.col("p_partkey").alias("location"))

    def freshness(self) -> DataFrame:
        o = self.raw("orders").groupBy("o_custkey").agg(F.max(epoch("o_orderdate")).alias("last"), F.count(F.lit(1)).alias("commits"))
        return o.select(F.concat(F.lit("ctx/c"), "o_custkey", F.lit(".md")).alias("file"), "last", "commits")

    def activity(self) -> DataFrame:
        e = self.tool_events()
        user = F.substring("session_id", 2, 20).cast("long")
        return e.select("id", F.col("created_at").alias("timestamp"), F.concat(F.lit("agent-"), user % 5).alias("agent"), F.concat(F.lit("src/f"), "result_count", F.lit(".rs")).alias("path"), F.col("tool").alias("kind"))

    def _parts(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("k"), "p_name", "p_brand", "p_type", "p_size")

    def _dealt_parts(self) -> DataFrame:
        """The parts, dealt to several tasks a core: each becomes a source that takes Python some milliseconds, and a file of all parts may be one task's."""
        tasks = max(4 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return self._parts().repartition(tasks, "k")

    def source_paths(self) -> DataFrame:
        ends = ("rs", "py", "pyi", "ts", "tsx", "js", "jsx", "toml", "json", "yaml", "yml", "md", "markdown", "bin", "tar.gz", "py/file")
        return self._parts().select("k", F.concat(F.lit("src/f"), "k", F.lit("."), _pick(F.col("k") % 16, ends)).alias("file_path"))

    def code_files(self) -> DataFrame:
        """A small Python source per part; those of every third part end with a call."""
        body = F.concat(F.lit("import os\n\n\ndef f"), "k", F.lit("(x):\n    return run(x)\n\n\nclass C"), "k", F.lit(":\n    def load(self):\n        return self.run("), "k", F.lit(")\n"))
        end = F.when(F.col("k") % 3 == 0, F.concat(F.lit("\n\nprint(f"), "k", F.lit("(1))\n"))).otherwise("")
        return self._dealt_parts().select("k", F.concat(F.lit("src/p"), "k", F.lit(".py")).alias("file_path"), F.lit("python").alias("language"), F.concat(body, end).alias("content"))

    def mixed_code(self) -> DataFrame:
        """A source per part in Rust, TypeScript or Python; every sixth's is one large Rust module."""
        from trailhead.plans import fixtures

        whole = {lang: "\n".join(x[3] for x in parts) for lang, parts in (*fixtures.CODE_PARTS.items(), ("big", fixtures.CODE_BIG))}
        k = F.col("k")
        pick = lambda of: F.when(k % 6 == 5, of("big")).when(k % 3 == 0, of("rust")).when(k % 3 == 1, of("typescript")).otherwise(of("python"))
        language = pick(lambda x: F.lit("rust" if x == "big" else x))
        return self._dealt_parts().select("k", F.concat(F.lit("src/m"), "k").alias("file_path"), language.alias("language"), F.replace(pick(lambda x: F.lit(whole[x])), F.lit("~"), k.cast("string")).alias("content"))

    def script_docs(self) -> DataFrame:
        body = F.concat(F.lit("use npm run "), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(", pnpm "), F.lower("p_type"), F.lit(" or yarn --frozen; then pnpm run ("), "p_size", F.lit(") and npm run \""), "p_brand", F.lit("\"."), F.when(F.col("k") % 5 == 0, " npm run").otherwise(""))
        return self._parts().select(F.concat(F.lit("docs/p"), "k", F.lit(".md")).alias("file"), body.alias("body"))

    def declared_scripts(self) -> DataFrame:
        return self._parts().where("k % 2 = 0").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("script")).distinct()

    def convention_files(self) -> DataFrame:
        """A convention file per supplier."""
        k = F.col("s_suppkey")
        text = F.concat(
            F.lit("[[rule]]\nscope = \"src"), k % 13, F.lit("/"), _pick(k % 5, ("en", "de", "fr", "es", "xx")), F.lit("/*"), _pick(k % 2, (".txt\"", ".md\"")), F.lit("\nlanguage = '"), _pick(k % 4, ("rust", "cobol", "python", "go")),
            F.lit("'\ncheck_pattern = \""), _pick(k % 3, ("$X.unwrap()", "", "print($X)")), F.lit("\"\nskill = \"skill-"), k % 7, F.lit("\"\n# severity: "), _pick(k % 4, ("error", "warning", "info", "none")), F.lit("\nnote = error-free\n"),
        )
        return self.raw("supplier").select(F.concat(F.lit("conv/s"), "s_suppkey", F.lit(".toml")).alias("file"), text.alias("body"))

    def skill_files(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.raw("nation").where("n_nationkey < 5").select(F.concat(F.lit("skill-"), k, _pick(k % 3, (".md", ".yaml", ".exe"))).alias("file"))

    def index_files(self) -> DataFrame:
        return self._parts().select(F.concat(F.lit("- ["), "p_name", F.lit("](p"), "k", F.lit(".md) and [x](q"), F.col("k") % 7, F.lit(".md)\nplain (line)")).alias("body"))

    def pattern_files(self) -> DataFrame:
        return self._parts().select(F.concat(F.when(F.col("k") % 5 == 0, "r").otherwise("p"), "k", F.lit(".md")).alias("file"))

    def titled_docs(self) -> DataFrame:
        k = F.col("k") % 4
        body = F.when(k == 0, F.concat(F.lit("# "), "p_name", F.lit("\ntext"))).when(k == 1, F.concat(F.lit("intro\n# "), "p_type", F.lit(" \n# more"))).when(k == 2, "no heading").otherwise("# \ntext")
        return self._parts().select(F.concat(F.lit("doc"), "k").alias("name"), body.alias("content"))

    def worktree_listings(self) -> DataFrame:
        k = F.col("s_suppkey")
        first = F.concat(F.lit("worktree /w/main"), k, F.lit("\nHEAD "), F.md5(k.cast("string").cast("binary")), F.lit("\nbranch refs/heads/b"), k, F.lit("\n"))
        return self.raw("supplier").select(k.alias("project"), F.concat(first, F.lit("\n"), F.when(k % 2 == 0, F.concat(F.lit("worktree /w/side"), k, F.lit("\nHEAD bbbb\ndetached\nlocked reason\nprunable gone\n"))).otherwise("")).alias("body"))

    def watched_paths(self) -> DataFrame:
        k = F.col("k")
        return self._parts().select("k", F.concat(_pick(k % 4, ("/work/", "", "/other/", "/work/")), _pick(k % 6, (".git/", "src/", "target/", "node_modules/", "docs/target/", ".activity/")), F.lit("f"), k, _pick(k % 5, (".rs", ".swp", ".tmp", ".py", "\\b.rs"))).alias("path"))

    def judged(self) -> DataFrame:
        k = F.col("turn") % 3
        good = F.concat(F.lit("Here is it: {\"verdict\": \""), "role", F.lit("\", \"risks\": ["), F.when(k == 0, F.concat(F.lit("\"r"), "turn", F.lit("\", \"s\""))).otherwise(""), F.lit("]} thanks"))
        return self.raw("conversations").select("conv_id", "turn", F.when(k == 2, "no json at all").otherwise(good).alias("raw"))

    def doc_templates(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("# {{ "), F.lower("c_mktsegment"), F.lit(" }}\nby {{n"), "c_nationkey", F.lit("}} {{ x y }} about {{ "), F.lower("c_mktsegment"), F.lit(" }}")).alias("body"))

    def manifest_files(self) -> DataFrame:
        body = F.concat(F.lit("{\"dependencies\": {\""), "p_name", F.lit("\": \""), "p_brand", F.lit("\"}, \"devDependencies\": {\""), "p_type", F.lit("\": \"^"), "p_size", F.lit("\"}}"))
        return self._parts().select(F.concat(F.lit("pkg/p"), "k", F.lit("/package.json")).alias("file_path"), F.when(F.col("k") % 50 == 0, "{}").otherwise(body).alias("content"))

    def edge_requests(self) -> DataFrame:
        """Edges that are there, new ones and loops."""
        o = self.raw("orders").select(F.col("o_orderkey").alias("i")).where("i % 10 = 0 and i > 0")
        return o.select(F.concat(F.lit("i"), "i").alias("from_id"), F.concat(F.lit("i"), F.when(F.col("i") % 3 == 0, F.col("i")).when(F.col("i") % 3 == 1, F.expr("i div 2")).otherwise(F.col("i") + 1)).alias("to_id"), F.lit("depends_on").alias("kind"))


class _Streamed(Tables):
    def raw(self, name: str) -> DataFrame:
        table, path = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"), f"{self.sf_dir}/{name}.parquet"
        reader = self.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 16)
        if any(f.endswith(f"/{name}.parquet") for f in table.inputFiles()):  # a file, not a folder of files
            return reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)
        return reader.parquet(path)
