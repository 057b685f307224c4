"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat_format, exact_dedup, html_text, jaccard_join, lang_id, line_dedup, packing, prefix_trie, quality_rules, runs, secret_scan, simhash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.quality_scores(table(spark, sf_dir, "documents"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return scored.select("doc_id", *base, "base_failed", "kept", "p_good", "against")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("n_chars_before"))
    return line_dedup.line_dedup(docs).select("doc_id", "n_chars_before", F.length("text").alias("n_chars"), "text")


def with_quoting(conversations: DataFrame) -> DataFrame:
    """The conversations, and beside each one (as -1 - conv_id) the same with quotes: every turn from the third on quotes the one two turns
    before, and every fourth also what that one quoted, a level deeper."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    whole = rows.dropDuplicates(["conv_id", "turn"]).where("conv_id IS NOT NULL AND turn IS NOT NULL")
    lines = lambda c, mark: F.concat(F.lit(mark), F.replace(c, F.lit("\n"), F.lit(f"\n{mark}")), F.lit("\n"))
    earlier = lambda n: whole.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(f"text_{n}"))
    both = whole.join(earlier(2), ["conv_id", "turn"], "left").join(earlier(4), ["conv_id", "turn"], "left")
    deeper = F.when(F.col("turn") % 4 == 0, F.coalesce(lines(F.col("text_4"), "> > "), F.lit(""))).otherwise("")
    quoted = F.when(F.col("text_2").isNotNull(), F.concat(deeper, lines(F.col("text_2"), "> "), F.lit("\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    return rows.unionByName(both.select((-1 - F.col("conv_id")).alias("conv_id"), "turn", "role", quoted.alias("text")))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without their quotes and what they answer, over the given conversations and the same ones with quotes; and with each message
    the block of 256 turns of training text that it is in, by its digest and length."""
    chat = chat_format.format_chat(with_quoting(table(spark, sf_dir, "conversations")))
    blocks = chat_format.render(chat).select("conv_id", "block", F.sha2("text", 256).alias("block_sha256"), F.length("text").alias("block_chars"))
    return chat.withColumn("block", F.floor(F.col("turn") / 256)).join(blocks, ["conv_id", "block"], "left")


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rank = lambda s: F.array_position(F.lit(list(secret_scan.ORDER)), s["kind"])
    keyed = F.transform(F.concat("base", "decoded"), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.select(
        "doc_id",
        *[count(k) for k in secret_scan.BASE],
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.array_sort(keyed)).alias("spans"),
        spans_text(F.col("closed")).alias("closed"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.token_estimate(F.col("text")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode(table(spark, sf_dir, "documents"), tokenizer)
    digests = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "ids")
    decoded = bpe.decode(digests, tokenizer, keep=["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.similar_fingerprints(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), replant=True)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), share=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op10_bpe": op10_bpe,
    "op11_simhash": op11_simhash,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_prefix_trie": op13_prefix_trie,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_html_text": op3_html_text,
    "op4_language_id": op4_language_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_chat_format": op6_chat_format,
    "op8_packing": op8_packing,
    "op7_secret_scan": op7_secret_scan,
    "op9_exact_dedup": op9_exact_dedup,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc32_sql(text: str) -> str:
    """CRC-32 (unsigned) of a text of ASCII characters, bit by bit."""
    shifted = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT), lambda crc, byte: {shifted}, 4294967295::BIGINT), 4294967295::BIGINT)"


ORACLES: dict[str, str] = {
    "op12_periodic_runs": rf"""
        WITH split AS (SELECT row_number() OVER () AS r, doc_id, {crc32_sql("doc_id::VARCHAR")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sized AS (SELECT *, len(w) AS n, h // 10 AS g FROM split),
        placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized),
        texts AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w
          ELSE list_concat(w[1:a], list_transform(range(n - a), lambda i: w[a + 1 + i % (1 + (n - a) // (3 + g % 8))])) END AS w FROM placed),
        words AS MATERIALIZED (SELECT r, n, unnest(w) AS x, unnest(range(n)) AS i FROM texts),
        same AS (SELECT a.r, b.i - a.i AS p, a.i, a.i - row_number() OVER (PARTITION BY a.r, b.i - a.i ORDER BY a.i) AS island
          FROM words a JOIN words b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
        stretches AS (SELECT r, p, min(i) AS s, count(*) + p AS len FROM same GROUP BY r, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
        runs AS MATERIALIZED (SELECT r, s, len, min(p) AS p FROM stretches GROUP BY r, s, len),
        best AS (SELECT r, count(*) AS n_runs, arg_min((s, len, p), (-len::DOUBLE / p, s, p)) AS b, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS listed FROM runs GROUP BY r),
        gone AS (SELECT DISTINCT r, unnest(range(s + p, s + len)) AS i FROM runs),
        kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b[1] AS start, b[2] AS length, b[3] AS period, (1000 * b[2] // b[3])::BIGINT AS exponent_milli,
               sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
        FROM texts LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
    """,
    "op13_prefix_trie": f"""
        WITH turns AS (SELECT conv_id AS c, coalesce(text, '') AS text, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x
          FROM conversations WHERE conv_id IS NOT NULL),
        placed AS MATERIALIZED (SELECT c, x, length(text) AS n_chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, x) - 1 AS pos FROM turns),
        own AS (SELECT c, count(*) AS n_own, {crc32_sql("c::VARCHAR")} % 6 AS h FROM placed GROUP BY c),
        plan AS (SELECT a.c, a.h, a.c - (a.c % 100 + 100) % 100 AS base, least(a.h, coalesce(b.n_own, 0)) AS taken FROM own a LEFT JOIN own b ON b.c = a.c - (a.c % 100 + 100) % 100),
        rebuilt AS (SELECT plan.c, pos, x, n_chars FROM plan JOIN placed ON placed.c = base WHERE pos < taken
          UNION ALL SELECT plan.c, pos - h + taken, x, n_chars FROM plan JOIN placed USING (c) WHERE pos >= h),
        seqs AS (SELECT c, coalesce(string_agg(x, '' ORDER BY pos), '') AS path, coalesce(list(n_chars ORDER BY pos) FILTER (x IS NOT NULL), []) AS sizes FROM plan LEFT JOIN rebuilt USING (c) GROUP BY c),
        members AS (SELECT c, d, path[: 64 * d] AS node, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS n_chars, length(path) = 64 * d AS ends FROM seqs, unnest(range(len(sizes) + 1)) AS u(d)),
        nodes AS MATERIALIZED (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n_chars) AS saved,
          sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY node, d),
        children AS (SELECT node[: 64 * (d - 1)] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
        full_nodes AS MATERIALIZED (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
        subtrees AS (SELECT node[: 64 * k] AS node, count_if(n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM full_nodes, unnest(range(d + 1)) AS u(k) GROUP BY 1)
        SELECT n.conv_id, d AS depth, (SELECT up.conv_id FROM nodes up WHERE up.node = n.node[: 64 * (n.d - 1)] AND n.d > 0) AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
        FROM full_nodes n JOIN subtrees USING (node)
    """,
    "op9_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, {LOWER} AS norm FROM documents)
        WINDOW same AS (PARTITION BY norm)
    """,
    "op2_jaccard_join": rf"""
        WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
          ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM worded),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b FROM reached r JOIN ways ON a = r.other)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
    """,
}
