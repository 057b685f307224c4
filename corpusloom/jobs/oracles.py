"""The same queries in SQL, as another engine would run them over the same tables."""

from __future__ import annotations

from corpusloom.functions.text import ANSWER_STOP_WORDS, QUERY_STOP_WORDS, RULE_WORDS, SECTION_WORDS

NL = "chr(10)"
STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
TOKENS = lambda x: f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+')"
EXACT = lambda x: f"CAST({x} AS DOUBLE)"



def noise(x: str) -> str:
    """A line x is noise."""
    t = STRIP(f"coalesce({x}, '')")
    tests = [f"{t} = ''", f"contains({t}, '....')"]
    for p in (r"^\d+\s*/\s*\d+$", r"^第\d+页\s*/\s*第\d+页$", "^null$", r"^[.\s·•\-—]+$", r"^本文件(共)?提取\s*\d+\s*[张个]", r"^!\[.*render\.png\]", r"^\|[\s\-|]+\|\s*$"):
        tests.append(f"regexp_matches({t}, '{p}')")
    tests += [f"(regexp_matches({t}, '^#{{1,3}}\\s*图片') AND length({t}) < 30)", f"(regexp_matches({t}, '^第\\d+页') AND length({t}) < 25)"]
    return "(" + " OR ".join(tests) + f" OR {toc(t)})"


def toc(x: str) -> str:
    filled = f"list_filter(list_transform(string_split({x}, {NL}), lambda l: {STRIP('l')}), lambda l: l <> '')"
    return f"(len({filled}) >= 3 AND len(list_filter({filled}, lambda l: regexp_matches(l, '^\\d+(\\.\\d+)*\\s+\\S.*\\d{{1,3}}$'))) >= len({filled}) * 0.6)"


def classify(x: str) -> str:
    t = STRIP(x)
    count = lambda test: f"len(list_filter(string_split({t}, {NL}), lambda l: {test}))"
    piped = count(f"contains(l, '|') AND length({STRIP('l')}) > 5")
    pairs = count(f"regexp_matches({STRIP('l')}, '^[^\\s：:]+\\s*[：:]\\s*\\S')")
    table = f"{piped} >= 2 OR {count('contains(l, chr(9))')} >= 2 OR {pairs} >= 4 OR contains({x}, '#DIV/0!') OR contains({x}, '#REF!')"
    han, buhan = (count(f"contains(l, '|') AND contains(l, '{w}')") for w in ("（含）", "（不含）"))
    return (
        f"CASE WHEN regexp_matches({x}, 'GLM-5V-Turbo|通过.*视觉模型.*描述|图片附件') THEN '图片描述' WHEN {table} THEN CASE WHEN {han} > {buhan} THEN '副表' ELSE '参数表' END "
        f"WHEN regexp_matches({x}, '{RULE_WORDS}') THEN '设计规则' ELSE '说明文本' END"
    )


PAGES = r"""pages_md AS (
    SELECT page_id AS doc_id, 'web' AS category, url AS source_file,
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
             '(?s)<(script|style|head)[^>]*>.*?</(script|style|head)>', '', 'g'),
             '<li><a href="[^"]*">([^<]*)</a></li>', chr(10) || '![\1](images/\1.png)' || chr(10), 'g'),
             '<h1>([^<]*)</h1>', chr(10) || chr(10) || '## \1' || chr(10) || chr(10), 'g'),
             '</?p>|<br>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS content
    FROM pages)"""

BLOCKS = rf"""parts AS (
    SELECT doc_id, category, generate_subscripts(p, 1) - 1 AS n, unnest(p) AS part
    FROM (SELECT doc_id, category, string_split(regexp_replace(content, '(?m)^(#{{1,2}}[ \t]+\S)', chr(1) || '\1', 'g'), chr(1)) AS p FROM pages_md)),
  titled AS (
    SELECT doc_id, category, n, CASE WHEN regexp_matches(part, '^#{{1,2}}[ \t]+\S') THEN {STRIP(f"string_split(part, {NL})[1]")} ELSE '' END AS title,
           {STRIP(f"CASE WHEN regexp_matches(part, '^#{{1,2}}[ ]+') THEN array_to_string(string_split(part, {NL})[2:], {NL}) ELSE part END")} AS raw
    FROM parts),
  noised AS (SELECT doc_id, category, n, title, CASE WHEN {noise("raw")} THEN '' ELSE raw END AS body FROM titled),
  blocks AS (SELECT doc_id, category, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS seq, title, body FROM noised WHERE title <> '' OR body <> '')"""

BLANKS = lambda text, source, keep: rf"""(
    SELECT {keep}, row_number() OVER (PARTITION BY {keep.split(', title')[0]} ORDER BY m) - 1 AS k, body FROM (
      SELECT {keep}, m, {STRIP('b')} AS body FROM (
        SELECT {keep}, generate_subscripts(p, 1) AS m, unnest(p) AS b FROM (SELECT {keep}, string_split_regex({text}, '\n\s*\n') AS p FROM {source})))
    WHERE body <> '' AND NOT {noise("body")})"""  # noqa: E731

HEADED = f"""headed AS (SELECT doc_id, CAST(seq * 10000 + k AS BIGINT) AS seq, title, body FROM {BLANKS("body", "blocks", "doc_id, seq, title")})"""
PAGE_BLOCKS = f"WITH {PAGES}, {BLOCKS}, {HEADED}"

CHUNKS = f"""chunks AS (
    SELECT doc_id AS chunk_index, lang AS category, source AS source_file, substr(string_split(text, {NL})[1], 1, 40) AS section_path,
           {classify("text")} AS content_type, text AS content
    FROM documents)"""
LEXICAL = f"""tokens AS MATERIALIZED (SELECT doc_id AS chunk_index, {TOKENS("text")} AS t FROM documents),
  lengths AS (SELECT chunk_index, len(t) AS dl FROM tokens),
  postings AS MATERIALIZED (SELECT term, chunk_index, count(*) AS tf FROM (SELECT chunk_index, unnest(t) AS term FROM tokens) GROUP BY term, chunk_index),
  totals AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM lengths),
  raw AS MATERIALIZED (SELECT term, count(*) AS df, ln((SELECT n_docs FROM totals) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM postings GROUP BY term),
  terms AS (SELECT term, df, CASE WHEN r < 0 THEN (SELECT 0.25 * avg(r) FROM raw) ELSE r END AS idf FROM raw)"""


def lexical_top(k: int = 50) -> str:
    return f"""asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS("text")}) AS term FROM benchmark) GROUP BY ALL),
  lexical AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index) AS rank, chunk_index, score FROM (
      SELECT query_id, chunk_index, round(sum(times * idf * {EXACT("tf")} * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM asked JOIN postings USING (term) JOIN terms USING (term) JOIN lengths USING (chunk_index), totals GROUP BY query_id, chunk_index)
    QUALIFY rank <= {k})"""


def vector_top(k: int = 50) -> str:
    cosine = "round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"
    return f"""nearest AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index) AS rank, chunk_index, score FROM (
      SELECT item_id AS query_id, v.vec_id AS chunk_index, {cosine} AS score
      FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings v WHERE v.vec_id IN (SELECT doc_id FROM documents))
    QUALIFY rank <= {k})"""


FUSED = """fused AS (
    SELECT query_id, chunk_index, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0 NULLS LAST, r1 NULLS LAST, chunk_index) AS fused_rank FROM (
      SELECT query_id, chunk_index, round(sum(CAST(w AS DOUBLE) / (20 + rank)), 9) AS score, min(CASE WHEN l = 0 THEN rank END) AS r0, min(CASE WHEN l = 1 THEN rank END) AS r1
      FROM (SELECT query_id, chunk_index, rank, 0.3 AS w, 0 AS l FROM nearest UNION ALL SELECT query_id, chunk_index, rank, 0.7, 1 FROM lexical) GROUP BY query_id, chunk_index)
    QUALIFY fused_rank <= 40)"""
DIVERSE = """ranked AS (
    SELECT f.*, source_file, min(fused_rank) OVER (PARTITION BY query_id, source_file) AS best,
           row_number() OVER (PARTITION BY query_id, source_file ORDER BY fused_rank) AS n FROM fused f JOIN chunks USING (chunk_index)),
  filed AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY best) AS file_rank FROM ranked),
  diverse AS (SELECT query_id, chunk_index, score, fused_rank, source_file, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS rank FROM filed WHERE file_rank <= 5 AND n <= 2 QUALIFY rank <= 10)"""


def labelled(source: str) -> str:
    return f"""labelled AS (
    SELECT query_id, chunk_index, round(score, 6) AS relevance_score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, fused_rank) AS rank,
           CASE WHEN round(score, 6) >= max(round(score, 6)) OVER (PARTITION BY query_id) * CAST(0.9 AS DOUBLE) THEN 'direct' ELSE 'indirect' END AS relevance FROM {source}),
  hits AS (SELECT * FROM labelled JOIN chunks USING (chunk_index))"""


LEGS = f"WITH {CHUNKS}, {LEXICAL}, {lexical_top()}, {vector_top()}, {FUSED}"
HITS = f"{LEGS}, {DIVERSE}, {labelled('diverse')}"


def stripped(x: str = "text", source: str = "documents", key: str = "doc_id") -> str:
    """Texts without pipe tables: a line goes if it is a row, or blank or piped with a row as the last line that decides."""
    return rf"""SELECT {key}, regexp_replace({STRIP("s")}, '\n{{3,}}', {NL} || {NL}, 'g') AS stripped FROM (
    SELECT {key}, string_agg(line, {NL} ORDER BY i) FILTER (WHERE NOT (is_row OR (neutral AND coalesce(state, false)))) AS s FROM (
      SELECT *, last_value(CASE WHEN is_row THEN true WHEN NOT neutral THEN false END IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY i) AS state FROM (
        SELECT {key}, i, line, starts_with(t, '|') AND contains(substr(t, 2), '|') AS is_row, t = '' OR starts_with(t, '|') AS neutral FROM (
          SELECT {key}, i, line, {STRIP("line")} AS t FROM (
            SELECT {key}, generate_subscripts(p, 1) AS i, unnest(p) AS line FROM (SELECT {key}, string_split({x}, {NL}) AS p FROM {source})))))
    GROUP BY {key})"""


ISLANDS = """runs AS (SELECT *, sum(long) OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM (SELECT *, CASE WHEN length(body) >= 50 THEN 1 ELSE 0 END AS long FROM headed))"""
STOPS = "['the', 'der', 'und', 'les']"
ANSWER_STOPS = " ".join(ANSWER_STOP_WORDS)


def content_tokens(x: str, stops: str) -> str:
    """Distinct tokens of two characters or more that are no stop words, in order of first use."""
    kept = f"list_filter({TOKENS(x)}, lambda w: length(w) >= 2 AND NOT list_contains({stops}, w))"
    return f"list_filter({kept}, lambda w, i: list_position({kept}, w) = i)"


def _context() -> str:
    header = "'[片段' || rank || '] 来源: ' || source_file || ' | 章节: ' || section_path || ' | 类型: ' || content_type"
    return rf"""{HITS}, bare AS ({stripped("content", "hits", "query_id, rank")}),
  context AS (SELECT query_id, string_agg({header} || {NL} || regexp_replace(regexp_replace(stripped, '(?s)~~(.+?)~~', '\1', 'g'), '!\[([^\]]*)\]\(images/[^)]+\)', '【附图：\1】', 'g'),
      {NL} || {NL} || '---' || {NL} || {NL} ORDER BY rank) AS context FROM hits JOIN bare USING (query_id, rank) WHERE rank <= 5 GROUP BY query_id)"""


CLEANED = r"regexp_replace(regexp_replace(replace(replace(content, ' the ', ' ~~the~~ '), ' a ', ' 2~3 '), '(?s)~~(.+?)~~', '\1', 'g'), '[～~]', '-', 'g')"

ORACLES: dict[str, str] = {
    "route_manifest": """
        SELECT page_id, 'p' || page_id || ext AS filename, ext, coalesce(CASE WHEN ext IN ('.pdf', '.doc') THEN CASE WHEN trim(c) = '' THEN 'zhipu' ELSE 'kreuzberg' END
            WHEN ext = '.docx' THEN 'python-docx' WHEN ext = '.xlsx' THEN 'openpyxl_xlrd' WHEN ext = '.txt' THEN 'txt_direct' END, 'unknown') AS parser,
          CASE WHEN ext = '.xyz' THEN 'error: unsupported format .xyz' ELSE 'success' END AS status, length(c) AS char_count
        FROM (SELECT page_id, ['.docx', '.pdf', '.xyz', '.txt', '.xlsx', '.doc'][page_id % 6 + 1] AS ext, CASE WHEN page_id % 4 = 0 THEN ' ' ELSE html END AS c FROM pages)""",
    "rows_to_markdown": f"""
        WITH brands AS (SELECT p_size, p_type, p_brand, '### ' || p_brand || {NL} || {NL} ||
            string_agg(CASE WHEN n = 1 THEN row || {NL} || '| --- | --- | --- | --- |' ELSE row END, {NL} ORDER BY n) || {NL} AS md
          FROM (SELECT *, '| ' || p_partkey || ' | ' || p_name || ' |  | ' || p_size || ' |' AS row, row_number() OVER (PARTITION BY p_size, p_type, p_brand ORDER BY p_partkey) AS n FROM part)
          GROUP BY p_size, p_type, p_brand),
        sheets AS (SELECT p_size, p_type, '## ' || p_type || {NL} || {NL} || string_agg(md, {NL} ORDER BY p_brand || ' 0') AS md FROM brands GROUP BY p_size, p_type)
        SELECT CAST(p_size AS BIGINT) AS doc_id, '# size ' || p_size || {NL} || {NL} || string_agg(md, {NL} ORDER BY p_type) AS content FROM sheets GROUP BY p_size""",
    "caption_candidates": """
        SELECT l_orderkey AS file, 'image' || l_linenumber AS filename, CAST(floor(l_extendedprice) AS BIGINT) AS size,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_extendedprice) DESC, 'image' || l_linenumber) AS place
        FROM lineitem WHERE floor(l_extendedprice) >= 8192 AND l_quantity <= 45 AND l_linenumber % 4 <> 0 QUALIFY place <= 5""",
    "noise_filter": f"""
        WITH {PAGES}, lines AS (SELECT doc_id, unnest(string_split(text, {NL})) AS line FROM documents UNION ALL SELECT -doc_id - 1, unnest(string_split(content, {NL})) FROM pages_md)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {noise("line")}) AS n_noise FROM lines GROUP BY doc_id""",
    "toc_blocks": f"""
        SELECT doc_id, {toc("text")} AS plain, {toc("lined")} AS lined FROM (SELECT doc_id, text, array_to_string(list_transform(string_split(replace(text, {NL}, ' '), ' '),
          lambda w, i: CASE WHEN (i - 1) % 3 < 2 THEN '1.' || (i - 1) || ' ' || w || ' ' || (i + 9) ELSE w END), {NL}) AS lined FROM documents)""",
    "image_refs": rf"""
        WITH {PAGES} SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, regexp_extract(m, '!\[([^\]]*)\]', 1) AS description, regexp_extract(m, '\(images/([^)]+)\)', 1) AS path, m AS markdown
        FROM (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS m FROM (SELECT doc_id, regexp_extract_all(content, '!\[[^\]]*\]\(images/[^)]+\)') AS p FROM pages_md))""",
    "classify_content": f"WITH {CHUNKS} SELECT chunk_index, content_type FROM chunks",
    "detect_section": rf"""
        WITH {PAGES}, p AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS part FROM (SELECT doc_id, string_split(content, {NL} || {NL}) AS s FROM pages_md)),
        f AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, {STRIP(f"string_split(part, {NL})[1]")} AS section FROM p)
        SELECT * FROM f WHERE regexp_matches(section, '^###?[ \t]+.+$|^[0-9]+(\.[0-9]+)*[ \t]+.+$') AND NOT contains(section, '....') AND NOT regexp_matches(section, 'render|page\d+')""",
    "strip_tables": f"SELECT doc_id, md5(stripped) AS stripped_md5 FROM ({stripped()})",
    "text_cleanup": rf"WITH {PAGES} SELECT doc_id, md5(regexp_replace({CLEANED}, '!\[([^\]]*)\]\(images/[^)]+\)', '【附图：\1】', 'g')) AS clean_md5 FROM pages_md",
    "desensitize": "SELECT doc_id, md5(replace(replace(replace(replace(text, 'AFTER', 'later'), 'then', 'AFTER'), 'the', 'THE'), 'der', 'DER')) AS clean_md5 FROM documents",
    "normalize_dirname": r"""SELECT page_id, CASE WHEN d = '' THEN 'document' ELSE d END AS dirname FROM (
        SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(url || ' _._ ', 'http', ''), '\s+', '_', 'g'), '_+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g') AS d FROM pages)""",
    "content_tokens": f"SELECT conv_id, turn, array_to_string({content_tokens('text', STOPS)}, ' ') AS tokens FROM conversations",
    "embed_text": f"WITH {CHUNKS} SELECT chunk_index, md5(content_type || '：' || section_path || ' | 来源: ' || source_file || {NL} || {NL} || content) AS text_md5 FROM chunks",
    "split_headings": f"WITH {PAGES}, {BLOCKS} SELECT doc_id, CAST(seq AS BIGINT) AS seq, title, body FROM blocks",
    "split_blank_lines": f"WITH {PAGES} SELECT doc_id, CAST(k AS BIGINT) AS seq, body FROM {BLANKS('content', 'pages_md', 'doc_id')}",
    "merge_short": f"""{PAGE_BLOCKS}, {ISLANDS}
        SELECT doc_id, min(seq) AS seq, coalesce(arg_min(title, seq) FILTER (WHERE title <> ''), '') AS title, string_agg(body, {NL} || {NL} ORDER BY seq) AS body FROM runs GROUP BY doc_id, run, long""",
    "merge_numbered": rf"""{PAGE_BLOCKS}, marked AS (SELECT doc_id, seq, title, CASE WHEN length(body) % 3 = 0 THEN '1. ' || body ELSE body END AS body FROM headed),
        grouped AS (SELECT *, sum(CASE WHEN row_number = 1 OR NOT regexp_matches(body, '^\d+[、.．)\s]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS grp
          FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS row_number FROM marked))
        SELECT doc_id, min(seq) AS seq, arg_min(title, seq) AS title, string_agg(body, {NL} ORDER BY seq) AS body FROM grouped GROUP BY doc_id, grp""",
    "carry_section": rf"""{PAGE_BLOCKS}, own AS (SELECT doc_id, seq, body, CASE
            WHEN regexp_matches({STRIP(f"string_split(body, {NL})[1]")}, '^###?[ \t]+.+$|^[0-9]+(\.[0-9]+)*[ \t]+.+$') AND NOT regexp_matches(string_split(body, {NL})[1], '\.\.\.\.|render|page\d+') THEN {STRIP(f"string_split(body, {NL})[1]")}
            WHEN seq % 3 = 0 AND title <> '' THEN title END AS own FROM headed),
        carried AS (SELECT doc_id, seq, body, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq), '') AS section_path FROM own)
        SELECT doc_id, seq, section_path, md5(CASE WHEN section_path <> '' AND NOT starts_with(body, section_path) THEN section_path || {NL} || {NL} || body ELSE body END) AS content_md5 FROM carried""",
    "enrich_neighbors": rf"""{PAGE_BLOCKS}, i AS (SELECT *, regexp_matches(body, '!\[[^\]]*\]\(images/[^)]+\)') AS img FROM headed),
        n AS (SELECT *, CASE WHEN NOT lag(img) OVER w THEN substr(lag(body) OVER w, 1, 200) END AS p, CASE WHEN NOT lead(img) OVER w THEN substr(lead(body) OVER w, 1, 200) END AS f FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY seq))
        SELECT doc_id, seq, md5(body || {NL} || {NL} || concat_ws({NL}, p, f)) AS enriched_md5 FROM n WHERE img AND (p IS NOT NULL OR f IS NOT NULL)""",
    "chunk_index": "SELECT lang AS category, source AS source_file, doc_id, row_number() OVER (ORDER BY lang COLLATE C, source COLLATE C, doc_id) - 1 AS chunk_index FROM documents",
    "bm25_postings": f"WITH {LEXICAL} SELECT term, chunk_index, tf, CAST(dl AS BIGINT) AS dl FROM postings JOIN lengths USING (chunk_index)",
    "bm25_term_stats": f"WITH {LEXICAL} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_doc_stats": f"WITH {LEXICAL} SELECT chunk_index, CAST(dl AS BIGINT) AS dl FROM lengths",
    "index_stats": f"WITH {LEXICAL}, v AS (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) SELECT (SELECT count(*) FROM lengths) AS n_chunks, (SELECT CAST(sum(dl) AS BIGINT) FROM lengths) AS n_tokens, (SELECT count(*) FROM v) AS n_vectors, (SELECT string_agg(DISTINCT CAST(len(embedding) AS VARCHAR), ',') FROM v) AS dims",
    "vector_table": f"WITH {CHUNKS} SELECT chunk_index, category, source_file, section_path, content_type, len(embedding) AS dim FROM chunks JOIN embeddings ON vec_id = chunk_index",
    "query_expand": """
        WITH s(ord, alias, canonical) AS (VALUES (1, 'ention', 'mention'), (2, 'ation', 'action'), (3, 'der', 'die'), (4, 'the', 'that')),
        q AS (SELECT conv_id || '-' || turn AS query_id, coalesce(text, '') AS query FROM conversations),
        a AS (SELECT query_id, string_agg(canonical, ' ' ORDER BY ord) AS added FROM q JOIN s ON contains(query, alias) AND NOT contains(query, canonical) GROUP BY query_id)
        SELECT query_id, query || coalesce(' ' || added, '') AS query FROM q LEFT JOIN a USING (query_id)""",
    "metadata_filter": f"WITH {CHUNKS} SELECT chunk_index, category, content_type FROM chunks WHERE category IN ('en', 'fr') AND content_type = '说明文本'",
    "bm25_topk": f"WITH {LEXICAL}, {lexical_top()} SELECT * FROM lexical",
    "vector_topk": f"WITH {vector_top(10)} SELECT * FROM nearest",
    "rrf_fuse": f"{LEGS} SELECT * FROM fused",
    "file_diversity": f"{LEGS}, {DIVERSE} SELECT query_id, rank, chunk_index, source_file FROM diverse",
    "hybrid_retrieve": f"{HITS} SELECT query_id, rank, chunk_index, relevance_score, relevance, source_file, category FROM hits",
    "label_relevance": f"{LEGS}, {labelled('fused')} SELECT query_id, rank, chunk_index, relevance_score, relevance FROM labelled",
    "search_citations": f"{HITS} SELECT query_id, rank, source_file, section_path, content_type, relevance_score, relevance, substr(content, 1, 200) AS excerpt FROM hits",
    "filename_boost": f"""
        WITH f AS (SELECT DISTINCT string_split(text, {NL})[1] || '.md' AS source_file, replace(string_split(text, {NL})[1] || '.md', '.md', '') AS name FROM documents),
        w AS (SELECT item_id AS query_id, list_filter({TOKENS("text")}, lambda x: length(x) >= 2) AS words FROM benchmark),
        u AS (SELECT query_id, len(words) AS n, unnest(words) AS word FROM w)
        SELECT query_id, source_file, round(1 + {EXACT("count(*)")} / n * 19, 6) AS boost FROM f JOIN u ON contains(name, word) GROUP BY query_id, source_file, n""",
    "followup_enrich": f"""
        WITH u AS (SELECT conv_id, turn, coalesce(CASE WHEN turn % 4 = 2 THEN substr(text, 1, 7) ELSE text END, '') AS query FROM conversations WHERE role = 'user'),
        l AS (SELECT *, lag(query) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM u),
        t AS (SELECT *, {content_tokens("query", f"string_split('{ANSWER_STOPS}', ' ')")} AS now, {content_tokens("coalesce(last, '')", f"string_split('{ANSWER_STOPS}', ' ')")} AS before FROM l),
        m AS (SELECT *, list_filter(before, lambda x: NOT list_contains(now, x)) AS missing, len(list_filter(now, lambda x: NOT list_contains(before, x))) AS new FROM t)
        SELECT conv_id, turn, query, CASE WHEN (len(now) < 3 OR new = 0) AND length(query) < 8 AND coalesce(last, '') <> ''
            THEN CASE WHEN len(missing) > 0 THEN query || ' ' || array_to_string(missing, ' ') ELSE last || ' ' || query END ELSE query END AS enriched_query FROM m""",
    "history_window": """
        SELECT conv_id, turn, CAST(len(h) AS BIGINT) AS n_history, md5(array_to_string(h, '|')) AS history_md5 FROM (
          SELECT conv_id, turn, coalesce(list(role || ':' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS h FROM conversations)""",
    "build_context": f"{_context()} SELECT query_id, md5(context) AS context_md5 FROM context",
    "build_messages": f"""{_context()} SELECT query_id, CAST(3 AS BIGINT) AS n_messages, md5('system:You answer from the given passages only.|user:hello|user:参考以下知识库内容回答问题。' || {NL} || {NL} || '--- 知识库内容 ---' || {NL}
        || context || {NL} || '--- 结束 ---' || {NL} || {NL} || '问题：' || text) AS messages_md5 FROM context JOIN benchmark ON item_id = query_id""",
    "source_list": f"""{HITS}, f AS (SELECT query_id, source_file, min(rank) AS first, arg_max(chunk_index, rank) AS chunk_index, arg_max(relevance, rank) AS relevance FROM hits GROUP BY query_id, source_file)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN relevance = 'direct' THEN 0 ELSE 1 END, first) AS place, source_file, chunk_index, relevance FROM f QUALIFY place <= 4""",
    "audit_report": f"""
        WITH {CHUNKS}, {LEXICAL}, v AS (SELECT len(embedding) AS d FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
        bare AS (SELECT count(*) AS n FROM chunks WHERE content_type IN ('参数表', '副表') AND regexp_matches(content, '\\|[-:\\s]+\\|')
          AND length({STRIP(f"array_to_string(list_filter(string_split(content, {NL}), lambda l: NOT starts_with({STRIP('l')}, '|')), {NL})")}) < 20),
        s AS (SELECT count(*) AS n, count(*) FILTER (WHERE {STRIP("content")} = '') AS empty, avg(CASE WHEN {STRIP("section_path")} <> '' THEN 1.0 ELSE 0 END) AS sections,
          count(DISTINCT source_file) AS files, avg(CASE WHEN contains(section_path, '>') THEN 1.0 ELSE 0 END) AS deep FROM chunks)
        SELECT 'chunk_count' AS name, n > 0 AND empty <= n * 0.1 AS passed, 'ERROR' AS level, {EXACT("n")} AS value FROM s
        UNION ALL SELECT 'section_paths', n > 0 AND sections >= 0.7, 'WARN', {EXACT("round(sections, 6)")} FROM s
        UNION ALL SELECT 'table_chunks', n = 0, 'WARN', {EXACT("n")} FROM bare
        UNION ALL SELECT 'file_diversity', files >= 2, 'WARN', {EXACT("files")} FROM s
        UNION ALL SELECT 'hierarchy_depth', n > 0, 'INFO', {EXACT("round(deep, 6)")} FROM s
        UNION ALL SELECT 'embedding_dims', min(d) = 64 AND max(d) = 64, 'ERROR', {EXACT("max(d)")} FROM v
        UNION ALL SELECT 'bm25_index', sum(dl) > 0, 'ERROR', {EXACT("sum(dl)")} FROM lengths""",
}


# ---- chunking, answers and audit: what takes more than one step


def quoted(x: str) -> str:
    return f"replace(url_encode({x}), '%2F', '/')"


def cut(text: str, pattern: str, source: str, keep: str) -> str:
    """Rows (keep, n, part) of a text cut before each match of pattern."""
    return rf"""(SELECT {keep}, generate_subscripts(p, 1) AS n, unnest(p) AS part FROM (
      SELECT {keep}, string_split(regexp_replace({text}, '(?m)^({pattern})', chr(1) || '\1', 'g'), chr(1)) AS p FROM {source}))"""


FIRST = lambda x: STRIP(f"string_split({x}, {NL})[1]")
REST = lambda x: STRIP(f"array_to_string(string_split({x}, {NL})[2:], {NL})")
QUIET = lambda x: f"CASE WHEN {noise(x)} THEN '' ELSE {x} END"
CN = "一二三四五六七八九十"


def strategy(c: str) -> str:
    rows = f"list_filter(string_split({c}, {NL}), lambda l: starts_with({STRIP('l')}, '|'))"
    cells = f"list_filter(list_transform(string_split(l, '|'), lambda y: {STRIP('y')}), lambda y: y <> '')"
    titled = f"len(list_filter({rows}, lambda l: starts_with(l, '|') AND len({cells}) = 1 AND length({cells}[1]) >= 10)) > 0"
    return (
        f"CASE WHEN len(regexp_extract_all({c}, '【[^】]+】')) >= 2 THEN 'BRACKET' WHEN len({rows}) >= 4 AND len({rows}) >= len(string_split({c}, {NL})) * 0.3 AND {titled} THEN 'TABLE' "
        f"WHEN regexp_matches({c}, '(?m)^#{{2,3}}[ \\t]+\\S') THEN 'H2' WHEN regexp_matches({c}, '(?m)^[{CN}]+、[ \\t]*\\S') OR regexp_matches({c}, '(?m)^[0-9]+(\\.[0-9]+)*[ \\t]+\\S') THEN 'CN+DIGIT' ELSE 'NL' END"
    )


IMAGES = r"regexp_extract_all({0}, '!\[[^\]]*\]\(images/([^)]+)\)', 1)"


def refs(source: str, keep: str) -> str:
    return rf"""(SELECT {keep}, CAST(i - 1 AS INTEGER) AS pos, regexp_extract(m, '!\[([^\]]*)\]', 1) AS description, regexp_extract(m, '\(images/([^)]+)\)', 1) AS path
        FROM (SELECT {keep}, generate_subscripts(p, 1) AS i, unnest(p) AS m FROM (SELECT {keep}, regexp_extract_all(content, '!\[[^\]]*\]\(images/[^)]+\)') AS p FROM {source})))"""


PAGE_HITS = f"""{PAGE_BLOCKS}, asked AS (SELECT doc_id AS query_id, title AS query, body AS content, length(body) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rank,
    CASE WHEN length(body) % 2 = 0 THEN 'direct' ELSE 'indirect' END AS relevance, 'a b/' || length(body) || '.png' AS path FROM headed)"""


def page_images(query: str, most: int, where: str = "true") -> str:
    tokens = content_tokens("query", f"string_split('{ANSWER_STOPS}', ' ')")
    return f"""gated AS (SELECT * FROM (SELECT query_id, {query} AS query, content, n, rank, relevance, path FROM asked) WHERE {where}
        AND (len({tokens}) = 0 OR len(list_filter({tokens}, lambda t: contains(content, t))) > 0)),
      once AS (SELECT *, CASE WHEN relevance = 'direct' THEN 0 ELSE 1 END AS grp FROM gated QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY grp, rank) = 1),
      images AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY grp, rank) AS place, path, relevance, '![附图](/api/images/web/' || {quoted("path")} || ')' AS url FROM once QUALIFY place <= {most})"""


SHEETS = ORACLES["rows_to_markdown"].strip()
TABLES = rf"""sheet_docs AS ({SHEETS}), sheet_hits AS (SELECT doc_id AS query_id, i AS rank, part AS content, CASE WHEN i % 2 = 1 THEN 'direct' ELSE 'indirect' END AS relevance,
      round({EXACT("1.0")} / (i + 20), 6) AS relevance_score FROM (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS part FROM (SELECT doc_id, string_split(content, {NL} || '## ') AS p FROM sheet_docs))),
    near AS (SELECT * FROM sheet_hits WHERE rank <= 5 AND regexp_matches(content, '\|[-:\s]+\|') AND (contains(content, 'widget') OR contains(content, 'bolt') OR contains(content, 'Brand'))),
    piped AS (SELECT query_id, rank, relevance, relevance_score, no, line, no - row_number() OVER (PARTITION BY query_id, rank ORDER BY no) AS island FROM (
      SELECT query_id, rank, relevance, relevance_score, generate_subscripts(l, 1) AS no, unnest(l) AS line FROM (SELECT *, string_split(content, {NL}) AS l FROM near)) WHERE contains(line, '|')),
    drawn AS (SELECT query_id, rank, relevance, relevance_score, min(no) AS no, bool_or(regexp_matches(line, '^\|[-:\s]+\|')) AS ruled, {STRIP(f"string_agg(line, {NL} ORDER BY no)")} AS table_text
      FROM piped GROUP BY query_id, rank, relevance, relevance_score, island),
    counted AS (SELECT *, CAST(contains(table_text, 'widget') AS INT) + CAST(contains(table_text, 'bolt') AS INT) + CAST(contains(table_text, 'Brand') AS INT) AS found FROM drawn WHERE ruled AND length(table_text) >= 20),
    scored AS (SELECT *, round(CASE WHEN relevance = 'direct' THEN relevance_score * 10 + found * {EXACT("0.01")} ELSE found + relevance_score END, 6) AS score FROM counted WHERE (relevance = 'direct' AND relevance_score > 0) OR (relevance <> 'direct' AND found >= 2)),
    distinct_tables AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, relevance, table_text ORDER BY score DESC, rank, no) = 1),
    tables AS (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id, relevance ORDER BY score DESC, rank, no) AS place, table_text, score FROM distinct_tables QUALIFY place <= 2)"""


def media(kind: str, relevance: str, heading: str, separator: str) -> str:
    own = f"string_agg(item, {separator} ORDER BY place) FILTER (WHERE kind = '{kind}' AND relevance = '{relevance}')"
    return f"{heading} || {own}"


#: The pages as chunks. Their headings are all of the second level, so each is split at headings.
PAGE_CHUNKS = rf"""WITH {PAGES}, {BLOCKS}, headed AS (SELECT doc_id, seq, title, body FROM blocks WHERE NOT {noise("body")}), {ISLANDS},
  merged AS (SELECT doc_id, min(seq) AS seq, coalesce(arg_min(title, seq) FILTER (WHERE title <> ''), '') AS title, {STRIP(f"string_agg(body, {NL} || {NL} ORDER BY seq)")} AS body FROM runs GROUP BY doc_id, run, long),
  starts AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1 OR NOT regexp_matches(body, '^\d+[、.．)\s]') AS starts FROM merged),
  items AS (SELECT doc_id, min(seq) AS seq, arg_min(title, seq) AS title, string_agg(body, {NL} ORDER BY seq) AS body FROM (
    SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS grp FROM starts) GROUP BY doc_id, grp),
  own AS (SELECT *, CASE WHEN regexp_matches({FIRST("body")}, '^###?[ \t]+.+$|^[0-9]+(\.[0-9]+)*[ \t]+.+$') AND NOT regexp_matches({FIRST("body")}, '\.\.\.\.|render|page\d+') THEN {FIRST("body")} WHEN title <> '' THEN title END AS own FROM items),
  carried AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq), '') AS section_path FROM own),
  filled AS (SELECT *, CASE WHEN section_path <> '' AND NOT starts_with(body, section_path) THEN section_path || {NL} || {NL} || body ELSE body END AS content FROM carried),
  pictured AS (SELECT *, {IMAGES.format("content")} AS image_ids FROM filled),
  beside AS (SELECT *, len(image_ids) > 0 AS has_image, CASE WHEN len(lag(image_ids) OVER w) = 0 THEN substr(lag(content) OVER w, 1, 200) END AS b,
    CASE WHEN len(lead(image_ids) OVER w) = 0 THEN substr(lead(content) OVER w, 1, 200) END AS f FROM pictured WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
  page_chunks AS (SELECT row_number() OVER (ORDER BY category COLLATE C, source_file COLLATE C, doc_id, seq) - 1 AS chunk_index, doc_id, CAST(seq AS BIGINT) AS seq, category, source_file, section_path,
    {classify("body")} AS content_type, beside.content, 'H2' AS split_strategy, has_image, array_to_string(image_ids, ',') AS image_ids,
    CASE WHEN has_image AND (b IS NOT NULL OR f IS NOT NULL) THEN beside.content || {NL} || {NL} || concat_ws({NL}, b, f) END AS enriched_content FROM beside JOIN (SELECT doc_id, category, source_file FROM pages_md) USING (doc_id))"""

RETRIEVABLE = f"""WITH {CHUNKS}, {LEXICAL}, sample AS (SELECT * FROM chunks WHERE {STRIP("coalesce(content, '')")} <> '' ORDER BY md5(CAST(chunk_index AS VARCHAR)), chunk_index LIMIT 20),
  asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT chunk_index AS query_id, unnest(list_filter({TOKENS("content")}, lambda x: length(x) >= 2)[:5]) AS term FROM sample) GROUP BY ALL),
  best AS (SELECT query_id, chunk_index AS best FROM (SELECT query_id, chunk_index, round(sum(times * idf * {EXACT("tf")} * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM asked JOIN postings USING (term) JOIN terms USING (term) JOIN lengths USING (chunk_index), totals GROUP BY query_id, chunk_index) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index) = 1)"""

ORACLES |= {
    "choose_strategy": f"""WITH {PAGES}, c AS (SELECT doc_id AS id, 'page' AS kind, content FROM pages_md UNION ALL SELECT doc_id, 'document', text FROM documents
        UNION ALL SELECT doc_id, 'brackets', regexp_replace(text, '([A-Z][^.]*\\.)', '【\\1】', 'g') FROM documents UNION ALL SELECT doc_id, 'numbered', regexp_replace(text, '(?m)^([A-Z])', '一、\\1', 'g') FROM documents)
        SELECT id, kind, {strategy("content")} AS strategy FROM c""",
    "split_subheadings": rf"""WITH {PAGES}, m AS (SELECT doc_id, regexp_replace(content, '(?m)^([A-Z]\S+ \S+)', '### \1', 'g') AS body FROM pages_md),
        p AS (SELECT *, regexp_matches(part, '^###[ \t]+\S') AS headed FROM {cut("body", r"###[ \t]+\S", "m", "doc_id, body")}),
        k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS seq, headed, part FROM p WHERE regexp_matches(body, '(?m)^###[ \t]+\S') AND (headed OR NOT {noise("part")}))
        SELECT doc_id, CAST(seq AS INTEGER) AS seq, CASE WHEN headed THEN 'web > ' || {FIRST("part")} ELSE 'web' END AS title, CASE WHEN headed THEN {QUIET(REST("part"))} ELSE {STRIP("part")} END AS body FROM k
        UNION ALL SELECT doc_id, 0, 'web', body FROM m WHERE NOT regexp_matches(body, '(?m)^###[ \t]+\S')""",
    "split_numbered": rf"""WITH m AS (SELECT doc_id, regexp_replace(text, '(?m)^([A-Z])', CASE WHEN doc_id % 2 = 0 THEN '1.2 \1' ELSE '三、\1' END, 'g') AS t FROM documents),
        p AS (SELECT doc_id, n, regexp_matches(part, '^(?:[{CN}]+、|[0-9]+(?:\.[0-9]+)*[ \t]+[^0-9])') AS headed, part FROM {cut("t", rf"(?:[{CN}]+、|[0-9]+(?:\.[0-9]+)*[ \t]+[^0-9])", "m", "doc_id")}),
        b AS (SELECT doc_id, n, CASE WHEN headed THEN {FIRST("part")} ELSE '' END AS title, CASE WHEN headed THEN {QUIET(REST("part"))} ELSE {QUIET(STRIP("part"))} END AS body FROM p)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS seq, title, md5(body) AS body_md5 FROM b WHERE title <> '' OR body <> ''""",
    "split_brackets": rf"""WITH m AS (SELECT doc_id, regexp_replace(text, '([A-Z][^.]*\.)', '【\1】', 'g') AS t FROM documents),
        p AS (SELECT doc_id, generate_subscripts(b, 1) AS i, unnest(b) AS held, g FROM (SELECT doc_id, regexp_extract_all(t, '【([^】]+)】', 1) AS b, string_split_regex(t, '【[^】]+】') AS g FROM m)),
        s AS (SELECT doc_id, i, {STRIP("held")} AS held, {STRIP("g[i + 1]")} AS gap FROM p)
        SELECT doc_id, CAST(i - 1 AS INTEGER) AS seq, {FIRST("held")} AS title, CASE WHEN gap = '' THEN held ELSE held || {NL} || gap END AS body FROM s""",
    "image_bindings": f"""{PAGE_BLOCKS}, c AS (SELECT source_file, seq AS chunk_index, body AS content FROM headed JOIN (SELECT doc_id, source_file FROM pages_md) USING (doc_id) WHERE length(body) % 2 = 0),
        b AS (SELECT * FROM {refs("c", "source_file, chunk_index")}), l AS (SELECT * FROM {refs("pages_md", "source_file")})
        SELECT source_file, chunk_index, pos, description, path, true AS bound FROM b UNION ALL
        SELECT source_file, -1, pos, description, path, false FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source_file = l.source_file AND b.path = l.path)""",
    "chunk_stats": f"""WITH {PAGES} SELECT 'web' AS source_file, split_strategy, content_type, count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_images FROM (
        SELECT {strategy("content")} AS split_strategy, {classify("content")} AS content_type, len({IMAGES.format("content")}) AS n FROM pages_md) GROUP BY ALL""",
    "rewrite_image_urls": rf"""WITH {PAGES}, p AS (SELECT doc_id, generate_subscripts(g, 1) AS i, unnest(g) AS gap, l FROM (
          SELECT doc_id, string_split_regex(content, '\]\(images/[^)]+\)') AS g, regexp_extract_all(content, '\]\(images/([^)]+)\)', 1) AS l FROM pages_md))
        SELECT doc_id, md5(string_agg(gap || coalesce('](/api/images/web/' || {quoted("l[i]")} || ')', ''), '' ORDER BY i)) AS rewritten_md5 FROM p GROUP BY doc_id""",
    "elements_to_markdown": rf"""WITH {PAGES}, l AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS seq, unnest(p) AS line FROM (SELECT doc_id, string_split(content, {NL}) AS p FROM pages_md)),
        w AS (SELECT doc_id, seq, line, string_split(line, ' ') AS w FROM l),
        d AS (SELECT doc_id, seq, CASE WHEN trim(array_to_string(w, ' '), ' ') = '' THEN NULL
          WHEN seq % 7 = 3 THEN '| ' || array_to_string(w, ' | ') || ' |' || {NL} || '| ' || array_to_string(list_transform(w, lambda x: '---'), ' | ') || ' |' || {NL}
            || '| ' || array_to_string(list_concat([line], list_transform(w[2:], lambda x: '')), ' | ') || ' |' || {NL}
          WHEN starts_with(line, '##') THEN '###### ' || trim(line, ' ') || {NL} WHEN seq % 5 = 0 THEN '## ' || trim(line, ' ') || {NL}
          ELSE array_to_string(list_transform(w, lambda x, i: repeat('*', CASE (i - 1) % 6 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 1 END) || x || ' '
            || repeat('*', CASE (i - 1) % 6 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 1 END)), '') || {NL} END AS md FROM w)
        SELECT doc_id, string_agg(md, {NL} ORDER BY seq) AS content FROM d WHERE md IS NOT NULL GROUP BY doc_id""",
    "embed_hash": f"WITH {CHUNKS} SELECT chunk_index, sha256(content_type || '：' || section_path || ' | 来源: ' || source_file || {NL} || {NL} || content) AS text_hash, CAST(64 AS INTEGER) AS dim, {EXACT('1')} AS norm FROM chunks",
    "rerank": f"""{LEGS}, t AS (SELECT query_id, fused_rank, chunk_index, count(*) OVER (PARTITION BY query_id) AS n, list_distinct({TOKENS("b.text")}) AS x, list_distinct({TOKENS("substr(d.text, 1, 500)")}) AS y
          FROM fused JOIN benchmark b ON item_id = query_id JOIN documents d ON d.doc_id = chunk_index WHERE fused_rank <= 15),
        s AS (SELECT query_id, fused_rank, chunk_index, CASE WHEN n > 3 THEN round({EXACT("len(list_intersect(x, y))")} / greatest(len(list_distinct(list_concat(x, y))), 1), 6) END AS rerank_score FROM t)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, fused_rank) AS rank, chunk_index, rerank_score FROM s QUALIFY rank <= 10""",
    "source_images": f"{PAGE_HITS}, {page_images('query', 8)} SELECT * FROM images",
    "image_intent": f"{PAGE_HITS}, {page_images("CASE WHEN query_id % 3 = 0 THEN query || ' 附图' ELSE query END", 2, "regexp_matches(query, '图|图纸|大样|示意图|标注|尺寸图|附图')")} SELECT * FROM images",
    "source_tables": f"WITH {TABLES} SELECT * FROM tables",
    "media_sections": f"""{PAGE_HITS}, {page_images("query", 8)}, {TABLES}, items AS (SELECT query_id, 'image' AS kind, relevance, place, url AS item FROM images UNION ALL SELECT query_id, 'table', relevance, place, table_text FROM tables)
        SELECT query_id, {NL} || {NL} || '---' || {NL} || concat_ws({NL} || {NL}, {media("image", "direct", f"'### 直接参考图片' || {NL}", NL)}, {media("table", "direct", f"'### 直接参考表格' || {NL} || {NL}", f"{NL} || {NL}")},
          {media("image", "indirect", f"'### 拓展参考图片' || {NL}", NL)}, {media("table", "indirect", f"'### 拓展参考表格' || {NL} || {NL}", f"{NL} || {NL}")}) AS media FROM items GROUP BY query_id""",
    "chunk_documents": f"{PAGE_CHUNKS} SELECT * FROM page_chunks",
    "image_columns": f"WITH {PAGES} SELECT doc_id, len({IMAGES.format('content')}) > 0 AS has_image, array_to_string({IMAGES.format('content')}, ',') AS image_ids FROM pages_md",
    "audit_retrievability": f"{RETRIEVABLE} SELECT chunk_index AS query_id, best FROM sample LEFT JOIN best ON query_id = chunk_index",
    "describe_files": r"""SELECT page_id, 'f' || page_id || e AS stem_ext, e AS ext, CASE WHEN page_id % 2 = 0 THEN 'f' || page_id || e ELSE substr(md5(CAST(page_id AS VARCHAR)), 1, 8) || '_f' || page_id || e END AS filename,
        CAST(octet_length(encode(html)) AS BIGINT) AS length FROM (SELECT *, ['.txt', '.pdf', '.doc', '.md'][page_id % 5 + 1] AS e FROM pages) WHERE e IS NOT NULL""",
    "parse_text": f"SELECT page_id, md5('# p' || page_id || {NL} || {NL} || html) AS content_md5, length(html) + length('p' || page_id) + 4 AS char_count FROM pages",
    "chunks_roundtrip": f"WITH {CHUNKS} SELECT chunk_index, category, source_file, section_path, content_type, md5(content) AS content_md5, 'a,b' || chunk_index AS image_ids FROM chunks",
    "table_roundtrip": "SELECT p_partkey, p_brand, p_type FROM part",
    "read_terms": "SELECT DISTINCT trim(p_type, ' ') AS term FROM part WHERE trim(p_type, ' ') <> ''",
    "read_synonyms": "SELECT trim(n_name, ' ') AS alias, r_name AS canonical FROM nation JOIN region ON r_regionkey = n_regionkey",
    "vectors_cached": f"WITH {CHUNKS} SELECT chunk_index, sha256(content_type || '：' || section_path || ' | 来源: ' || source_file || {NL} || {NL} || content) AS text_hash, chunk_index % 2 = 0 AS from_cache FROM chunks",
    "audit_run": f"""WITH r AS ({ORACLES["audit_report"]}), h AS (SELECT count(*) FILTER (WHERE chunk_index = best) AS hits, count(*) AS n FROM ({RETRIEVABLE.replace("LIMIT 20", "LIMIT 3")} SELECT chunk_index, best FROM sample LEFT JOIN best ON query_id = chunk_index)),
        a AS (SELECT name, passed, level FROM r UNION ALL SELECT 'retrievability', n >= 3 AND hits >= 2, 'ERROR' FROM h) SELECT bool_and(passed OR level <> 'ERROR') AS passed, count(*) FILTER (WHERE NOT passed) AS n_failed FROM a""",
    "ingest_stream": f"{PAGE_CHUNKS} SELECT doc_id, seq, category, source_file, section_path, content_type, content, split_strategy, has_image, image_ids, enriched_content FROM page_chunks",
}

#: What filtered_queries gives each query: null lists allow everything.
PERMITTED = """CASE query_id % 5 WHEN 1 THEN c.category IN ('en', 'fr') WHEN 2 THEN c.content_type = '参数表' WHEN 3 THEN c.category = 'de' AND c.content_type = '说明文本' WHEN 4 THEN c.category = 'xx' ELSE true END"""
EXPANDED = """expanded AS (SELECT item_id AS query_id, text || coalesce(' ' || string_agg(canonical, ' ' ORDER BY ord), '') AS text FROM benchmark
    LEFT JOIN (VALUES (1, 'ention', 'mention'), (2, 'ation', 'action'), (3, 'der', 'die'), (4, 'the', 'that')) s(ord, alias, canonical) ON contains(text, alias) AND NOT contains(text, canonical) GROUP BY item_id, text)"""


def lexical_filtered(k: int, source: str) -> str:
    return f"""asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS("text")}) AS term FROM {source}) GROUP BY ALL),
  sums AS (SELECT query_id, chunk_index, round(sum(times * idf * {EXACT("tf")} * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM asked JOIN postings USING (term) JOIN terms USING (term) JOIN lengths USING (chunk_index), totals GROUP BY query_id, chunk_index),
  lexical AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index) AS rank, chunk_index, score FROM sums JOIN chunks c USING (chunk_index) WHERE {PERMITTED} QUALIFY rank <= {k})"""


def nearest_filtered(k: int) -> str:
    cosine = "round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"
    return f"""cosines AS (SELECT item_id AS query_id, v.vec_id AS chunk_index, {cosine} AS score FROM benchmark JOIN embeddings q ON q.vec_id = item_id, embeddings v),
  nearest AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index) AS rank, chunk_index, score FROM cosines JOIN chunks c USING (chunk_index) WHERE {PERMITTED} QUALIFY rank <= {k})"""


ORACLES |= {
    "bm25_topk_filtered": f"WITH {CHUNKS}, {LEXICAL}, {lexical_filtered(10, '(SELECT item_id AS query_id, text FROM benchmark)')} SELECT * FROM lexical",
    "vector_topk_filtered": f"WITH {CHUNKS}, {nearest_filtered(10)} SELECT * FROM nearest",
    "retrieve_filtered": f"""WITH {CHUNKS}, {LEXICAL}, {EXPANDED}, {lexical_filtered(50, 'expanded')}, {nearest_filtered(50)}, {FUSED}, {DIVERSE}, {labelled('diverse')},
        pairs AS (SELECT h.*, count(*) OVER (PARTITION BY query_id) AS n, list_distinct({TOKENS("e.text")}) AS x, list_distinct({TOKENS("substr(content, 1, 500)")}) AS y FROM hits h JOIN expanded e USING (query_id))
        SELECT query_id, rank, chunk_index, relevance_score, relevance, CASE WHEN n > 3 THEN round({EXACT("len(list_intersect(x, y))")} / greatest(len(list_distinct(list_concat(x, y))), 1), 6) END AS rerank_score, source_file, category FROM pairs""",
}

SEGMENTED = "replace(text, ' the ', ' 配电 系统照明 ')"
COMPOUND = "replace(text, ' the ', ' 配电系统 照明 ')"
ORACLES |= {
    "bm25_dictionary": f"WITH {LEXICAL.replace(TOKENS('text'), TOKENS(COMPOUND))}, {lexical_top(10).replace(TOKENS('text'), TOKENS(COMPOUND))} SELECT * FROM lexical",
    "media_inventory": """WITH e AS (SELECT page_id, 'word/media/i' || i || '.png' AS source, 'i' || i AS stem, 100 * i + page_id % 50 AS size FROM pages, range(4) r(i) WHERE i <= page_id % 4
          UNION ALL SELECT page_id, 'ppt/media/i0.png', 'i0', 7 FROM pages WHERE page_id % 2 = 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY page_id, stem ORDER BY source) - 1 AS n FROM e)
        SELECT 'f' || page_id AS file, stem || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.png' AS filename, '.png' AS ext, size, source FROM n""",
}

#: The pages of each host as one file, under a heading with its name.
HOST_FILES = PAGES.replace("pages_md AS", "each_page AS") + rf""", pages_md AS (SELECT min(doc_id) AS doc_id, 'web' AS category, regexp_extract(source_file, '//([^/]+)', 1) || '.md' AS source_file,
    '# ' || regexp_extract(source_file, '//([^/]+)', 1) || {NL} || {NL} || string_agg(content, {NL} || {NL} ORDER BY doc_id) AS content FROM each_page GROUP BY regexp_extract(source_file, '//([^/]+)', 1))"""
ORACLES |= {
    "vector_bounds": ORACLES["vector_topk"],
    "ivf_recall": f"WITH {vector_top(10)} SELECT count(*) AS n_neighbours, true AS enough FROM nearest",
    "ingest_terms": f"{PAGE_CHUNKS}, {LEXICAL.replace(TOKENS('text'), TOKENS('content')).replace('SELECT doc_id AS chunk_index', 'SELECT chunk_index').replace('FROM documents', 'FROM page_chunks')} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "ingest_files": f"{PAGE_CHUNKS.replace(PAGES, HOST_FILES)} SELECT seq, category, source_file, section_path, content_type, content, split_strategy, has_image, image_ids, enriched_content, true AS placed FROM page_chunks",
    "bm25_padded": rf"""WITH {LEXICAL}, asked AS (SELECT item_id AS query_id, {TOKENS("text")}[-1] AS term FROM benchmark WHERE {TOKENS("text")}[-1] NOT IN (SELECT unnest(string_split('{" ".join(QUERY_STOP_WORDS)}', ' ')))),
  scored AS (SELECT query_id, chunk_index, round(idf * {EXACT("tf")} * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM totals))), 6) AS score FROM asked JOIN postings USING (term) JOIN terms USING (term) JOIN lengths USING (chunk_index)),
  pairs AS (SELECT item_id AS query_id, doc_id AS chunk_index FROM benchmark, documents WHERE item_id % 3 <> 0 OR lang = 'en')
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score IS NULL, score DESC, chunk_index) AS rank, chunk_index, coalesce(score, 0) AS score
  FROM pairs LEFT JOIN scored USING (query_id, chunk_index) QUALIFY rank <= 10""",
    "split_table_sections": rf"""WITH sheet_docs AS ({SHEETS}),
  titled AS (SELECT doc_id, regexp_replace(replace(content, '### ', '| brand title row '), '(?m)^(\| brand title row .*)$', CASE WHEN doc_id % 2 = 0 THEN '\1 |  |' || {NL} || '| the northern 区域： |  |' ELSE '\1 |  |' END, 'g') AS content FROM sheet_docs),
  each AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(content, {NL}) AS p FROM titled)),
  cut AS (SELECT *, {STRIP("line")} AS line_row, list_filter(list_transform(string_split({STRIP("line")}, '|'), lambda x: {STRIP("x")}), lambda x: x <> '') AS cells FROM each),
  typed AS (SELECT *, CASE WHEN regexp_matches(line_row, '^\|[\s\-:]+\|\s*$') THEN 'rule' WHEN NOT starts_with(line_row, '|') THEN 'text' WHEN len(cells) = 1 AND length(cells[1]) >= 10 THEN 'title' ELSE 'data' END AS kind FROM cut),
  placed AS MATERIALIZED (SELECT doc_id, pos, line, kind, CASE WHEN kind = 'title' THEN rtrim(rtrim(cells[1], '：'), ':') END AS name, count(*) FILTER (kind IN ('text', 'title')) OVER doc AS seg,
    min(pos) FILTER (kind = 'data') OVER before AS head_pos, max(pos) FILTER (kind = 'rule') OVER before AS rule_pos FROM typed
    WINDOW doc AS (PARTITION BY doc_id ORDER BY pos), before AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  segs AS (SELECT p.doc_id, seg, arg_min(kind, p.pos) AS kind, arg_min(name, p.pos) AS name, arg_min(p.line, p.pos) AS line, coalesce(list(p.line ORDER BY p.pos) FILTER (kind IN ('rule', 'data')), []) AS own,
    arg_min(head_pos, p.pos) AS head_pos, arg_min(rule_pos, p.pos) AS rule_pos FROM placed p GROUP BY p.doc_id, seg),
  opened AS (SELECT s.*, CASE WHEN s.kind = 'title' THEN list_concat(list_filter([h.line, r.line], lambda x: x IS NOT NULL), own) ELSE own END AS table_rows FROM segs s
    LEFT JOIN each h ON h.doc_id = s.doc_id AND h.pos = s.head_pos LEFT JOIN each r ON r.doc_id = s.doc_id AND r.pos = s.rule_pos),
  had AS (SELECT *, coalesce(lag(len(table_rows) > 0) OVER (PARTITION BY doc_id ORDER BY seg), false) AS had FROM opened),
  chained AS (SELECT *, count(*) FILTER (had) OVER w AS lead_of, count(*) FILTER (had AND kind = 'text') OVER w AS chain FROM had WINDOW w AS (PARTITION BY doc_id ORDER BY seg)),
  based AS (SELECT *, count(*) FILTER (name IS NOT NULL AND NOT under) OVER (PARTITION BY doc_id, chain ORDER BY seg) AS base FROM (SELECT *, (name LIKE '%区域' OR length(name) <= 6)
    AND coalesce(max(length(name)) OVER (PARTITION BY doc_id, chain ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS under FROM chained)),
  made AS (SELECT doc_id, seg, coalesce(string_agg(name, '-') FILTER (name IS NOT NULL) OVER (PARTITION BY doc_id, chain, base ORDER BY seg), '') AS title,
    {STRIP(f"coalesce(string_agg(line, {NL}) FILTER (kind = 'text') OVER (PARTITION BY doc_id, lead_of ORDER BY seg), '')")} AS lead_text, {STRIP(f"array_to_string(table_rows, {NL})")} AS body FROM based WHERE true),
  found AS (SELECT doc_id, seg, title, CASE WHEN {noise("lead_text")} THEN body ELSE lead_text || {NL} || {NL} || body END AS body FROM made WHERE body <> '' AND NOT {noise("body")})
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg) - 1 AS seq, title, body FROM found""",
    "embed_images_inline": rf"""WITH RECURSIVE {PAGES},
  given AS (SELECT doc_id, regexp_extract_all(content, '!\[[^\]]*\]\(images/[^)]+\)') AS images,
    {STRIP(r"' ' || regexp_replace(content, '!\[[^\n]*\n', CASE doc_id % 5 WHEN 0 THEN '图 1' || chr(10) WHEN 1 THEN '参考图' || chr(10) WHEN 2 THEN '如下图所示' || chr(10) || '情况一：x' || chr(10) || '情况二: y' || chr(10) WHEN 3 THEN '附图二 示意图' || chr(10) ELSE '图 2 图3' || chr(10) END, 'g')")} AS stripped,
    regexp_extract(content, '^\s*') AS led FROM pages_md),
  docs AS (SELECT doc_id, images, led || stripped || {NL} AS text FROM given WHERE len(images) > 0),
  lines AS MATERIALIZED (SELECT doc_id, generate_subscripts(p, 1) - 1 AS i, unnest(p) AS line, len(p) AS n FROM (SELECT doc_id, string_split(text, {NL}) AS p FROM docs)),
  placed AS MATERIALIZED (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS behind FROM lines),
  pictures AS MATERIALIZED (SELECT doc_id, generate_subscripts(images, 1) - 1 AS k, unnest(images) AS image FROM docs),
  numbers AS (SELECT doc_id, TRY_CAST(x AS INTEGER) - 1 AS k, min(i) AS i FROM (SELECT doc_id, i, unnest(regexp_extract_all(line, '图\s*(\d+)', 1)) AS x FROM lines) GROUP BY ALL),
  numerals AS (SELECT doc_id, strpos('{CN}', x) - 1 AS k, min(i) AS i FROM (SELECT doc_id, i, unnest(regexp_extract_all(line, '附图\s*([{CN}]+)', 1)) AS x FROM lines) WHERE length(x) = 1 GROUP BY ALL),
  figured AS MATERIALIZED (SELECT p.doc_id, p.k, image, coalesce(a.i, b.i) AS i FROM pictures p LEFT JOIN numbers a USING (doc_id, k) LEFT JOIN numerals b ON b.doc_id = p.doc_id AND b.k = p.k),
  free AS MATERIALIZED (SELECT doc_id, image, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS f, count(*) OVER (PARTITION BY doc_id) AS n_free FROM figured WHERE i IS NULL),
  mentions AS (SELECT doc_id, i, behind, unnest(regexp_extract_all(line, '参考大样图|参考图|示意图|见附图|详见附图|如下图所示')) AS word FROM placed),
  cases AS (SELECT doc_id, i, behind - length(line) - 1 AS start FROM placed WHERE regexp_matches(line, '^情况[{CN}]+[：:]')),
  pointers AS MATERIALIZED (SELECT m.doc_id, i, row_number() OVER (PARTITION BY m.doc_id ORDER BY i) AS nth, coalesce((SELECT list(c.i ORDER BY c.i) FROM cases c WHERE c.doc_id = m.doc_id AND c.start >= m.behind AND c.start < m.behind + 800), []) AS near FROM mentions m),
  taken(doc_id, nth, n_free, used, at_lines) AS (SELECT doc_id, 0::BIGINT, any_value(n_free), 0::BIGINT, []::BIGINT[] FROM free GROUP BY doc_id
    UNION ALL SELECT t.doc_id, p.nth, n_free, used + len(mine), mine FROM (SELECT t.*, p.nth AS next, CASE WHEN n_free - used <= 0 THEN [] WHEN len(near) > 0 AND len(near) <= n_free - used THEN near ELSE [p.i] END AS mine
      FROM taken t JOIN pointers p ON p.doc_id = t.doc_id AND p.nth = t.nth + 1) t JOIN pointers p ON p.doc_id = t.doc_id AND p.nth = t.next),
  pointed AS (SELECT doc_id, unnest(at_lines) AS i, used - len(at_lines) + unnest(range(len(at_lines))) AS f FROM taken WHERE len(at_lines) > 0),
  rest AS (SELECT f.doc_id, image, row_number() OVER (PARTITION BY f.doc_id ORDER BY f) - 1 AS r FROM free f ANTI JOIN pointed USING (doc_id, f)),
  heads AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS h, count(*) OVER (PARTITION BY doc_id) AS n_heads FROM lines WHERE regexp_matches(line, '^##[ \t]+\S')),
  inserts AS (SELECT doc_id, i, 1 AS turn, image FROM figured WHERE i IS NOT NULL UNION ALL SELECT doc_id, i, 2, image FROM pointed JOIN free USING (doc_id, f)
    UNION ALL SELECT rest.doc_id, i, 3, image FROM rest JOIN heads ON heads.doc_id = rest.doc_id AND h = r % n_heads),
  shown AS (SELECT doc_id, i, string_agg(image, {NL} ORDER BY -turn, image) AS put, string_agg(image, {NL} ORDER BY turn, image) AS put_last FROM inserts GROUP BY doc_id, i),
  tails AS (SELECT doc_id, string_agg(image, {NL} ORDER BY r) AS tail FROM rest WHERE doc_id NOT IN (SELECT doc_id FROM heads) GROUP BY doc_id),
  made AS (SELECT doc_id, string_agg(CASE WHEN put IS NULL THEN line WHEN i = n - 1 THEN line || put_last || {NL} ELSE line || {NL} || put END, {NL} ORDER BY i) AS content FROM lines LEFT JOIN shown USING (doc_id, i) GROUP BY doc_id)
  SELECT doc_id, content || coalesce({NL} || {NL} || tail, '') AS content FROM made LEFT JOIN tails USING (doc_id)
  UNION ALL SELECT doc_id, led || stripped || {NL} || '本文件共 3 张图片。' || {NL} || '## 图片附件' || {NL} FROM given WHERE len(images) = 0""",
    "index_snapshot": ORACLES["bm25_term_stats"],
    "bindings_roundtrip": ORACLES["image_bindings"],
    "read_rules": "SELECT n_name AS pattern, r_name AS replacement FROM nation JOIN region ON r_regionkey = n_regionkey",
    "bm25_segmented": f"WITH {LEXICAL.replace(TOKENS('text'), TOKENS(SEGMENTED))}, {lexical_top(10).replace(TOKENS('text'), TOKENS(SEGMENTED))} SELECT * FROM lexical",
    "image_only_files": """SELECT o_orderkey AS file, count(l_linenumber) AS n_media, coalesce(any_value(o_orderkey % 3 <> 0) AND bool_or(l_quantity > 25) AND any_value(length(trim(repeat(o_orderpriority, o_orderkey % 20), ' '))) < 100, false) AS image_only
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "media_without_scraps": """SELECT l_orderkey AS file, count(*) AS n_media, CAST(sum(size) AS BIGINT) AS size FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) % 3000 AS size FROM lineitem)
        WHERE NOT (l_orderkey % 3 <> 0 AND size < 256 AND NOT l_quantity > 25) GROUP BY l_orderkey""",
    "cjk_rules": rf"""WITH made AS (SELECT doc_id, ['第' || doc_id || '页 / 第' || doc_id || '页', '本文件共提取 ' || doc_id || ' 张', '第' || doc_id || '页 ' || lang, '### 图片 ' || doc_id, '### 图片 ' || text, '一、' || text, '第三章 ' || text, '二  甲 ' || text,
    '适用范围' || {NL} || text, text || {NL} || '不应', '图片附件' || text, '| 甲（含） | x |' || {NL} || '| 乙乙乙 | y |' || {NL} || text, '甲：1' || {NL} || '乙： 2' || {NL} || '丙:3' || {NL} || '丁 : 4' || {NL} || text,
    '| （不含） | z |' || {NL} || '| 乙乙乙 | y |' || {NL} || text, '·•—', '四 ' || doc_id || ' 甲'] AS f FROM documents),
  forms AS (SELECT doc_id, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS form, unnest(f) AS x FROM made)
  SELECT doc_id, form, {noise("x")} AS noise, CASE WHEN regexp_matches({FIRST("x")}, '^(##[ \t]+.+|###[ \t]+.+|[{CN}]+、[ \t]*.+|第[{CN}百\d]+章[ \t]*.+|[{CN}]+[ \t]{{1,5}}[^\d\s].{{1,40}}|[0-9]+(\.[0-9]+)*[ \t]+.+|({SECTION_WORDS}))$')
    AND NOT regexp_matches({FIRST("x")}, '图片描述|第\s*\d+\s*页|render|page\d+|\.\.\.\.') THEN {FIRST("x")} END AS section, {classify("x")} AS content_type FROM forms""",
    "bm25_bounded": f"WITH {LEXICAL}, {lexical_top(10).replace(TOKENS('text'), TOKENS('text') + '[-4:]')} SELECT * FROM lexical",
}
