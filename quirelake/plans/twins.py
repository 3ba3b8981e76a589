"""SQL twins of the queries, for an independent engine on the same tables."""

from __future__ import annotations

from quirelake.operators.conversation import OPENERS, REFERRING
from quirelake.operators.grounding import DISCOURSE_WORDS, FUNCTION_WORDS
from quirelake.operators.passages import settings_fingerprint
from quirelake.operators.sections import VERBS

#: white space beyond ASCII, for an engine whose \s is ASCII
_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _tokens(column: str) -> str:
    return rf"regexp_extract_all(replace(lower({column}), 'ß', 'ss'), '[\pL\pN]+')"


def _json(column: str) -> str:
    return f"""('"' || replace(replace(replace(replace(replace({column}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"')"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _scores(k1: float = 1.5, b: float = 0.75, questions: str = "SELECT item_id AS query_id, text AS query FROM benchmark") -> str:
    """CTEs up to ``scored`` (query_id, passage_id, sequence, score)."""
    weight = f"tf * (1 + 1 / {k1}) / (tf / {k1} + norm)" if k1 >= 1 else f"tf / (tf + {k1} * norm) * ({k1} + 1)"
    return f"""
questions AS ({questions}),
wanted AS (SELECT DISTINCT query_id, unnest({_tokens('query')}) AS term FROM questions),
base AS (SELECT doc_id AS passage_id, {_tokens('text')} AS ts FROM documents),
sized AS (SELECT passage_id, len(ts) AS dl, md5(array_to_string(ts, ' ')) AS sequence, ts FROM base),
stats AS (SELECT count(*) AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM sized),
terms AS (SELECT DISTINCT term FROM wanted),
occ AS (SELECT passage_id, dl, sequence, unnest(ts) AS term FROM sized),
tf AS (SELECT passage_id, dl, sequence, term, count(*)::DOUBLE AS tf FROM occ SEMI JOIN terms USING (term) GROUP BY ALL),
idf AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avgdl FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), stats),
parts AS (SELECT passage_id, sequence, term, CAST(round(idf * ({weight}) * 1e12) AS BIGINT) AS part
          FROM (SELECT tf.*, idf, (1 - {b}) + {b} * (dl / avgdl) AS norm FROM tf JOIN idf USING (term))),
scored AS (SELECT * FROM (SELECT query_id, passage_id, sequence, (CAST(sum(part) AS BIGINT) + 500) // 1000 / 1e9 AS score
           FROM parts JOIN wanted USING (term) GROUP BY query_id, passage_id, sequence) WHERE score > 0)"""


def _ranked(k: int, dedup: bool = True, k1: float = 1.5, b: float = 0.75) -> str:
    """CTEs up to ``ranked`` (query_id, passage_id, score, rank)."""
    once = "WHERE copy = 1" if dedup else ""
    return f"""{_scores(k1, b)},
copies AS (SELECT *, row_number() OVER (PARTITION BY query_id, sequence ORDER BY score DESC, passage_id) AS copy FROM scored),
ranked AS (SELECT query_id, passage_id, score, rank FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM copies {once}) WHERE rank <= {k})"""


def _topk(**options: object) -> str:
    return f"WITH {_ranked(10, **options)} SELECT query_id, passage_id, score, rank, 'bm25-v1' AS retrieval_method FROM ranked"


_PER_QUERY = f"""{_ranked(5)},
judged AS (SELECT item_id AS query_id, doc_id AS passage_id FROM benchmark, labels WHERE quality = 1),
ks AS (SELECT unnest([1, 3, 5]) AS k),
totals AS (SELECT query_id, count(*) AS n_rel FROM judged GROUP BY 1),
hits AS (SELECT query_id, rank FROM ranked SEMI JOIN judged USING (query_id, passage_id)),
per_query AS (SELECT t.query_id, k, CASE WHEN count(rank) > 0 THEN 1.0 ELSE 0.0 END AS hit_rate, count(rank)::DOUBLE / any_value(n_rel) AS recall, coalesce(1.0 / min(rank), 0.0) AS mrr
  FROM totals t CROSS JOIN ks LEFT JOIN hits h ON h.query_id = t.query_id AND h.rank <= k GROUP BY t.query_id, k),
long AS (SELECT query_id, k, 'hit_rate' AS metric, hit_rate AS value FROM per_query UNION ALL SELECT query_id, k, 'recall', recall FROM per_query UNION ALL SELECT query_id, k, 'mrr', mrr FROM per_query),
measured AS (SELECT metric, k, round(avg(value), 9) AS value FROM long GROUP BY ALL),
thresholds AS (SELECT * FROM (VALUES ('hit_rate', 1, 0.6::DOUBLE), ('hit_rate', 3, 0.9), ('recall', 5, 0.9), ('mrr', 5, 0.75)) AS t(metric, k, minimum)),
failed AS (SELECT metric, k, minimum, value AS actual FROM measured JOIN thresholds USING (metric, k) WHERE value < minimum)"""

_CONTROL = r"[\x00-\x08\x0b\x0e-\x1f\x7f-\x{9f}]"

_PAGES = rf"""
numbered AS (SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number, text FROM documents),
runs AS (SELECT doc_id, page_number, sum(n) AS repeated FROM (
  SELECT doc_id, page_number, island, ch, count(*) AS n FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, page_number, ch ORDER BY i) AS island FROM (
      SELECT doc_id, page_number, i, substr(text, i, 1) AS ch FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM numbered)))
  GROUP BY ALL HAVING count(*) >= 12 AND NOT regexp_matches(ch, '[{_SPACES}]')) GROUP BY ALL),
measured AS (SELECT n.doc_id, n.page_number, length(text) AS characters, length(regexp_replace(text, '[{_SPACES}]', '', 'g')) AS non_whitespace,
  length(regexp_replace(text, '{_CONTROL}|[\t\n\r\f]', '', 'g')) AS printable, length(text) - length(regexp_replace(text, '{_CONTROL}', '', 'g')) AS controls,
  length(text) - length(replace(text, chr(65533), '')) AS replacements, CAST(coalesce(repeated, 0) AS BIGINT) AS repeated
  FROM numbered n LEFT JOIN runs r ON r.doc_id = n.doc_id AND r.page_number = n.page_number),
flagged AS (SELECT *, non_whitespace = 0 AS is_empty, non_whitespace BETWEEN 1 AND 79 AS is_sparse FROM measured),
docs AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (is_empty) AS empty_pages, count(*) FILTER (is_sparse) AS sparse_pages,
  CAST(sum(characters) AS BIGINT) AS characters, CAST(sum(non_whitespace) AS BIGINT) AS non_whitespace, CAST(sum(printable) AS BIGINT) AS printable,
  CAST(sum(controls) AS BIGINT) AS controls, CAST(sum(replacements) AS BIGINT) AS replacements, CAST(sum(repeated) AS BIGINT) AS repeated,
  min(non_whitespace) AS min_page, max(non_whitespace) AS max_page FROM flagged GROUP BY doc_id),
ratios AS (SELECT *, coalesce(empty_pages / nullif(pages, 0), 0.0) AS empty_ratio, coalesce(controls / nullif(characters, 0), 0.0) AS control_ratio,
  coalesce(replacements / nullif(characters, 0), 0.0) AS replacement_ratio, coalesce(repeated / nullif(non_whitespace, 0), 0.0) AS repeated_ratio,
  coalesce(max_page / nullif(non_whitespace, 0), 0.0) AS imbalance_ratio, coalesce(printable / nullif(characters, 0), 0.0) AS printable_ratio FROM docs),
coded AS (SELECT *, list_filter([
  CASE WHEN empty_pages = pages THEN 'all_pages_empty' END, CASE WHEN empty_pages BETWEEN 1 AND pages - 1 THEN 'empty_pages' END,
  CASE WHEN empty_pages BETWEEN 1 AND pages - 1 AND empty_ratio >= 0.5 THEN 'high_empty_page_ratio' END,
  CASE WHEN empty_pages < pages AND non_whitespace < 200 THEN 'very_low_text_volume' END, CASE WHEN sparse_pages > 0 THEN 'sparse_pages' END,
  CASE WHEN control_ratio >= 0.01 THEN 'control_characters' END, CASE WHEN replacement_ratio >= 0.01 THEN 'replacement_characters' END,
  CASE WHEN repeated > 0 THEN 'repeated_characters' END, CASE WHEN pages >= 4 AND imbalance_ratio >= 0.8 THEN 'severe_page_imbalance' END,
  CASE WHEN control_ratio >= 0.1 OR replacement_ratio >= 0.1 OR repeated_ratio >= 0.2 THEN 'extraction_garbage' END], lambda x: x IS NOT NULL) AS warnings FROM ratios)"""

_CUT = r"""
RECURSIVE pieces AS (
  SELECT doc_id, text AS rest, 0 AS start, 0 AS size, -1 AS no FROM documents WHERE length(trim(text, E' \n\t\r')) > 0
  UNION ALL
  SELECT doc_id, substr(rest, cut + 1), start + size, cut, no + 1 FROM (
    SELECT doc_id, rest, start, size, no, CASE WHEN length(rest) <= 1200 THEN length(rest)
      WHEN strpos(reverse(translate(left(rest, 1200), E'\n\t\r', '   ')), ' ') = 0 THEN 1200
      ELSE 1201 - strpos(reverse(translate(left(rest, 1200), E'\n\t\r', '   ')), ' ') END AS cut
    FROM pieces WHERE length(rest) > 0)),
cut AS (SELECT doc_id AS paper_id, no AS ordinal, start, start + size AS "end", substr(text, start + 1, size) AS text FROM pieces JOIN documents USING (doc_id) WHERE no >= 0)"""

#: a record for each document, broken by its source
_STORED = _CUT + f""",
cuts AS (SELECT paper_id, max(ordinal) AS top, count(*) AS n FROM cut GROUP BY 1),
broken AS (SELECT paper_id, problem FROM (
  SELECT doc_id AS paper_id, unnest(CASE WHEN n IS NULL THEN ['no_passages', 'blank_markdown'] ELSE [CASE source WHEN 'src0' THEN 'fragment_text' WHEN 'src2' THEN 'wrong_last_page' WHEN 'src1' THEN 'ordinal_gap' END,
    CASE source WHEN 'src1' THEN 'wrong_id' END, CASE WHEN source = 'src1' AND n > 1 THEN 'source_overlap' END] END || [CASE source WHEN 'src3' THEN 'wrong_digest' WHEN 'src4' THEN 'wrong_source' END]) AS problem FROM documents LEFT JOIN cuts ON paper_id = doc_id)
  WHERE problem IS NOT NULL)"""

_FILES = "files AS (SELECT printf('/library/%08d.txt', doc_id) AS path, length(text) AS size, sha256(text) AS sha256, source FROM documents)"
_CHECKED = f"""{_FILES},
firsts AS (SELECT sha256, min(path) AS first FROM files GROUP BY 1),
stored AS (SELECT DISTINCT sha256 FROM files WHERE source = 'src0'),
checked AS (SELECT path, size, f.sha256, s.sha256 IS NOT NULL AS is_stored, path <> first AS is_batch_duplicate, CASE WHEN path <> first THEN first END AS duplicate_of
  FROM files f JOIN firsts USING (sha256) LEFT JOIN stored s ON s.sha256 = f.sha256),
results AS (SELECT sha256, CASE WHEN is_batch_duplicate THEN 'duplicate' WHEN is_stored THEN 'reuse' ELSE 'new' END AS action,
  CASE WHEN size < 100 THEN 'halted' WHEN size < 150 THEN 'failed' ELSE 'completed' END AS status FROM checked)"""

_EVIDENCE = f"""{_ranked(3)},
evidence AS (SELECT query_id AS request_id, 'e' || rank AS citation_id, rank, passage_id AS paper_id, text FROM ranked JOIN documents ON doc_id = passage_id),
claims AS (SELECT request_id, rank - 1 AS claim_index, split_part(text, '.', 1) AS text FROM evidence),
said AS (SELECT request_id, claim_index, term, min(position) AS position FROM (
    SELECT request_id, claim_index, unnest(ts) AS term, unnest(range(0, len(ts))) AS position FROM (SELECT request_id, claim_index, {_tokens('text')} AS ts FROM claims))
  WHERE NOT list_contains({_list(FUNCTION_WORDS + DISCOURSE_WORDS)}, term) GROUP BY ALL),
known AS (SELECT DISTINCT request_id, paper_id, citation_id, unnest({_tokens('text')}) AS term FROM evidence),
asked AS (SELECT DISTINCT query_id AS request_id, unnest({_tokens('query')}) AS term FROM questions),
leaks AS (SELECT s.request_id, claim_index, s.term, position, list_sort(list(DISTINCT k.paper_id)) AS papers
  FROM said s JOIN known k ON k.request_id = s.request_id AND k.term = s.term
  WHERE NOT EXISTS (SELECT 1 FROM known o WHERE o.request_id = s.request_id AND o.term = s.term AND o.citation_id = 'e1')
    AND NOT EXISTS (SELECT 1 FROM asked a WHERE a.request_id = s.request_id AND a.term = s.term)
  GROUP BY ALL HAVING count(DISTINCT k.paper_id) <= 1),
grounded AS (SELECT c.request_id, c.claim_index, count(term) = 0 AS grounded,
  coalesce(string_agg(term, ',' ORDER BY position), '') AS leaked_terms,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(papers) FILTER (papers IS NOT NULL)))), ','), '') AS leaked_from_papers
  FROM claims c LEFT JOIN leaks l ON l.request_id = c.request_id AND l.claim_index = c.claim_index GROUP BY ALL)"""

_TURNS = """
ordered AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
turns AS (SELECT conv_id, turn, text AS question, CASE WHEN next_role = 'assistant' AND trim(coalesce(next_text, '')) <> '' THEN next_text END AS answer FROM ordered WHERE role = 'user'),
history AS (SELECT t.conv_id, t.turn, any_value(t.question) AS question, list(p.turn ORDER BY p.turn) FILTER (p.turn IS NOT NULL) AS earlier
  FROM turns t LEFT JOIN turns p ON p.conv_id = t.conv_id AND p.turn < t.turn AND p.answer IS NOT NULL GROUP BY t.conv_id, t.turn)"""

_FLAGGED = f"""
flagged AS (SELECT *, coalesce(earlier IS NOT NULL AND (list_has_any(ws, {_list(REFERRING)}) OR array_to_string(ws[1:2], ' ') IN ({', '.join(f"'{a} {b}'" for a, b in OPENERS)})), false) AS needs_context
  FROM (SELECT *, regexp_extract_all(lower(question), '[a-z0-9]+') AS ws FROM history))"""

_TRIM = rf"regexp_replace(raw, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g')"
_LINES = rf"""
split_lines AS (SELECT doc_id, page, unnest(ls) AS raw, unnest(range(0, len(ls))) AS no, len(ls) AS n FROM (SELECT doc_id, page, string_split(text, chr(10)) AS ls FROM paged)),
placed AS (SELECT *, CAST(coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id, page ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM split_lines),
lines AS (SELECT doc_id, page, start, start + length(regexp_replace(raw, '\r$', '')) AS "end", start + length(raw) + CASE WHEN no < n - 1 THEN 1 ELSE 0 END AS end_nl, {_TRIM} AS trimmed,
  row_number() OVER (PARTITION BY doc_id ORDER BY page, no) - 1 AS idx FROM placed WHERE NOT (no = n - 1 AND raw = '')),
near AS (SELECT *, coalesce(lag(trimmed) OVER w = '', true) AS prev_blank, coalesce(lead(trimmed) OVER w = '', true) AS next_blank,
  coalesce(lag(page) OVER w <> page, true) AS first_on_page, coalesce(lead(page) OVER w <> page, true) AS last_on_page FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY idx))"""
_ONE_PAGE = "paged AS (SELECT doc_id, 1 AS page, text FROM documents)," + _LINES
_VERBS = _list(VERBS)


def all_twins() -> dict[str, str]:
    stats = f"SELECT len({_tokens('text')}) AS dl FROM documents"
    return {
        "bm25_topk": _topk(),
        "bm25_indexed": _topk(),
        "bm25_no_dedup": _topk(dedup=False),
        "bm25_k1_small": _topk(k1=0.6),
        "bm25_b_zero": _topk(b=0.0),
        "bm25_single_query_limit": f"WITH {_scores(questions="SELECT 0 AS query_id, 'the road of this and that' AS query")} SELECT query_id, passage_id, score FROM scored ORDER BY score DESC, passage_id LIMIT 5",
        "bm25_term_freq": f"SELECT doc_id AS passage_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY ALL",
        "bm25_doc_freq": f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY term",
        "bm25_corpus_stats": f"SELECT count(*) AS n, CAST(sum(dl) AS BIGINT) AS total_tokens, round(sum(dl)::DOUBLE / count(*), 6) AS avgdl FROM ({stats})",
        "bm25_idf": f"SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY term), (SELECT count(*) AS n FROM documents)",
        "bm25_strict_tokens": _topk(),
        "retrieval_contract_violations": f"""WITH {_ranked(10)}, d AS (SELECT query_id, passage_id, CASE WHEN query_id % 5 = 0 AND rank >= 3 THEN rank + 1 ELSE rank END AS rank, CASE WHEN query_id % 5 = 1 AND rank = 5 THEN score + 1000 ELSE score END AS score,
              CASE WHEN query_id % 5 = 2 AND rank = 1 THEN 'other' ELSE 'bm25-v1' END AS method FROM ranked),
            e AS (SELECT * FROM d UNION ALL SELECT query_id, passage_id, 11, score, method FROM d WHERE query_id % 5 = 3 AND rank = 1),
            o AS (SELECT *, row_number() OVER w AS nth, lag(score) OVER w AS ls, lag(passage_id) OVER w AS lp FROM e WINDOW w AS (PARTITION BY query_id ORDER BY rank))
            SELECT query_id, 'rank_gap' AS problem FROM o WHERE rank <> nth UNION SELECT query_id, 'beyond_k' FROM o WHERE rank > 10 UNION SELECT query_id, 'score_order' FROM o WHERE score > ls UNION SELECT query_id, 'tie_order' FROM o WHERE score = ls AND passage_id < lp
            UNION SELECT query_id, 'duplicate_passage' FROM e GROUP BY query_id, passage_id HAVING count(*) > 1 UNION SELECT query_id, 'mixed_methods' FROM e GROUP BY query_id HAVING count(DISTINCT method) > 1""",
        "snapshot_violations": f"""WITH {_ranked(10)} SELECT query_id, passage_id, CASE lang WHEN 'es' THEN 'unknown_passage' WHEN 'fr' THEN 'other_paper' ELSE 'other_text' END AS problem
            FROM ranked JOIN documents ON doc_id = passage_id WHERE lang IN ('es', 'fr', 'de')""",
        "benchmark_violations": """WITH b AS (SELECT 'b-' || item_id AS benchmark_id, item_id % 6 AS kind FROM benchmark)
            SELECT benchmark_id, unnest(CASE kind WHEN 0 THEN ['corpus_fingerprint'] WHEN 1 THEN ['threshold_k'] WHEN 2 THEN ['k_not_increasing', 'repeated_threshold'] WHEN 3 THEN ['repeated_query'] WHEN 4 THEN ['blank_query'] ELSE ['repeated_judgment'] END) AS problem FROM b""",
        "generation_digests": f"""WITH {_EVIDENCE} SELECT request_id || '-' || citation_id AS case_id, citation_id AS citation_ids, false AS abstained, 'descriptive' AS finding_kinds, 'sha256:' || sha256('{{"abstained":false,"abstention_reason":null,"answer_text":' || {_json('text')}
            || ',"citations":[{{"citation_id":"' || citation_id || '","paper_id":"' || paper_id || '","passage_id":"' || paper_id || '"}}],"claims":[{{"citation_ids":["' || citation_id || '"],"text":' || {_json('text')} || '}}],"finding_kinds":["descriptive"],"generation_method":"stand-in"}}') AS response_digest FROM evidence""",
        "result_digest": f"""WITH {_ranked(10)}, q AS (SELECT query_id, '{{"query_id":"' || query_id || '","results":[' || string_agg('{{"passage_id":"' || passage_id || '","rank":' || rank || ',"retrieval_method":"bm25-v1"}}', ',' ORDER BY rank) || ']}}' AS t FROM ranked GROUP BY query_id)
            SELECT 'sha256:' || sha256('{{"queries":[' || string_agg(t, ',' ORDER BY query_id) || '],"schema_version":1}}') AS digest FROM q""",
        "citations_by_paper": f"""WITH {_ranked(5)}, g AS (SELECT query_id AS request_id, source AS paper_id, min(rank) AS best_rank, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY rank) AS ranks FROM ranked JOIN documents ON doc_id = passage_id GROUP BY ALL)
            SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY best_rank, paper_id) AS paper_order FROM g""",
        "eval_metrics_at_k": f"WITH {_PER_QUERY} SELECT * FROM measured",
        "eval_threshold_failures": f"WITH {_PER_QUERY} SELECT * FROM failed",
        "eval_affected_queries": f"WITH {_PER_QUERY} SELECT metric, k, string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY query_id) AS queries FROM long JOIN failed USING (metric, k) WHERE value < 1 GROUP BY ALL",
        "eval_timing_summary": "SELECT count(value) AS count, round(min(value), 6) AS minimum, round(median(value), 6) AS median, round(list_sort(list(value))[CAST(ceil(count(value) * 0.95) AS INT)], 6) AS p95, round(max(value), 6) AS maximum FROM events WHERE value IS NOT NULL",
        "unknown_judgments": f"WITH {_ranked(10)} SELECT doc_id AS passage_id, quality FROM labels WHERE doc_id NOT IN (SELECT passage_id FROM ranked)",
        "corpus_fingerprint": f"""WITH h AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 4096 AS block, doc_id, sha256('{{"paper_id":' || {_json('source')} || ',"passage_id":' || doc_id || ',"text":' || {_json('text')} || '}}') AS h FROM documents),
            b AS (SELECT block, sha256(string_agg(h, '' ORDER BY doc_id)) AS h FROM h GROUP BY block)
            SELECT 'sha256:' || CASE WHEN count(*) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY block)) END AS fingerprint FROM b""",
        "benchmark_fingerprint": f"""SELECT 'sha256:' || sha256('[' || string_agg('{{"query":' || {_json('text')} || ',"query_id":' || item_id || '}}', ',' ORDER BY item_id) || ']') AS fingerprint FROM benchmark""",
        "scaling_corpus_counts": """WITH base AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ordinal, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
            n AS (SELECT count(*) AS n FROM documents),
            made AS (SELECT source, length(text) + 38 + length(CAST(v + 1 AS VARCHAR)) AS size FROM (SELECT unnest(range(n, n * 5 // 2)) AS v, n FROM n) JOIN base ON i = v % n),
            everything AS (SELECT source, length(text) AS size FROM base UNION ALL SELECT * FROM made)
            SELECT source AS paper_id, count(*) AS passages, count(*) - 1 AS last_ordinal, count(*) AS ordinals, CAST(sum(size) AS BIGINT) AS characters FROM everything GROUP BY source""",
        "page_quality": f"WITH {_PAGES} SELECT * FROM flagged",
        "doc_quality": f"WITH {_PAGES} SELECT doc_id, pages, empty_pages, sparse_pages, characters, non_whitespace, printable, controls, replacements, repeated, min_page, max_page, {', '.join(f'round({c}, 9) AS {c}' for c in ('empty_ratio', 'control_ratio', 'replacement_ratio', 'repeated_ratio', 'imbalance_ratio', 'printable_ratio'))} FROM ratios",
        "quality_status": f"""WITH {_PAGES} SELECT doc_id, array_to_string(warnings, ',') AS warnings, CASE WHEN list_contains(warnings, 'extraction_garbage') THEN 'unusable'
            WHEN list_has_any(warnings, ['all_pages_empty', 'high_empty_page_ratio']) THEN 'likely_needs_ocr' WHEN len(warnings) > 0 THEN 'usable_with_warnings' ELSE 'usable' END AS status FROM coded""",
        "quality_warnings": f"""WITH {_PAGES}, w AS (SELECT doc_id, max_page, unnest(warnings) AS warning FROM coded)
            SELECT w.doc_id, warning, coalesce(string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) FILTER (CASE warning WHEN 'sparse_pages' THEN is_sparse WHEN 'control_characters' THEN controls > 0
              WHEN 'replacement_characters' THEN replacements > 0 WHEN 'repeated_characters' THEN repeated > 0 WHEN 'severe_page_imbalance' THEN non_whitespace = max_page
              WHEN 'empty_pages' THEN is_empty WHEN 'all_pages_empty' THEN is_empty WHEN 'high_empty_page_ratio' THEN is_empty ELSE false END), '') AS pages
            FROM w JOIN flagged f ON f.doc_id = w.doc_id GROUP BY w.doc_id, warning""",
        "measure_violations": """WITH n AS (SELECT source AS doc_id, count(*) AS n, sum(length(text)) FILTER (nth = 1) AS first FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents) GROUP BY 1)
            SELECT doc_id, 'characters' AS problem FROM n WHERE doc_id = 'src1' OR (doc_id = 'src2' AND (n = 1 OR first > 0)) UNION ALL SELECT doc_id, 'pages' FROM n WHERE doc_id = 'src2' UNION ALL SELECT doc_id, 'page_numbers' FROM n WHERE doc_id = 'src2' AND n > 1""",
        "passage_split": f"""WITH {_CUT} SELECT paper_id, 'passage-' || sha256('{{"ordinal_position":' || ordinal || ',"paper_id":"' || paper_id || '","section_kind":"document","settings_fingerprint":"{settings_fingerprint()}","text":' || {_json('text')} || '}}') AS passage_id,
            ordinal, start, "end", md5(text) AS text_md5 FROM cut""",
        "passage_stats": f"WITH {_CUT} SELECT paper_id, count(*) AS passages, CAST(sum(length(text)) AS BIGINT) AS characters, max(length(text)) AS longest FROM cut GROUP BY 1",
        "passage_fragments": f"""WITH {_CUT}, l AS (SELECT doc_id, no, raw, n FROM (SELECT doc_id, unnest(ls) AS raw, unnest(range(0, len(ls))) AS no, len(ls) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
            p AS (SELECT doc_id, no, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(raw) + CASE WHEN no < n - 1 THEN 1 ELSE 0 END AS size FROM l WHERE NOT (no = n - 1 AND raw = ''))
            SELECT paper_id, no AS page_number, CAST(greatest(start, a) - a AS BIGINT) AS page_start, CAST(least("end", a + size) - a AS BIGINT) AS page_end, CAST(greatest(start, a) - start AS BIGINT) AS passage_start, CAST(least("end", a + size) - start AS BIGINT) AS passage_end
            FROM cut JOIN p ON doc_id = paper_id AND start < a + size AND a < "end" """,
        "passage_violations": f"""WITH {_CUT}, p AS (SELECT doc_id, strpos(text, chr(10)) AS second FROM documents)
            SELECT 'passage-' || sha256('{{"ordinal_position":' || ordinal || ',"paper_id":"' || paper_id || '","section_kind":"document","settings_fingerprint":"{settings_fingerprint()}","text":' || {_json('cut.text')} || '}}') AS passage_id
            FROM cut JOIN p ON doc_id = paper_id JOIN documents d ON d.doc_id = paper_id
            WHERE second > 0 AND start < second + coalesce(nullif(strpos(substr(d.text, second + 1), chr(10)), 0), length(d.text)) AND "end" > second""",
        "record_violations": f"""WITH {_STORED} SELECT * FROM broken""",
        "valid_records": f"""WITH {_STORED} SELECT lang, count(*) AS papers FROM documents WHERE doc_id NOT IN (SELECT paper_id FROM broken) GROUP BY lang""",
        "assembled_records": f"""WITH {_CUT}, n AS (SELECT paper_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS size FROM cut GROUP BY 1),
            f AS (SELECT paper_id, CASE WHEN source = 'src1' AND ordinal = 0 THEN 90000 ELSE ordinal END AS place, 'passage-' || sha256('{{"ordinal_position":' || ordinal || ',"paper_id":"' || paper_id || '","section_kind":"document","settings_fingerprint":"{settings_fingerprint()}","text":' || {_json('cut.text')} || '}}') AS id FROM cut JOIN documents ON doc_id = paper_id)
            SELECT doc_id AS paper_id, coalesce(n, 0) AS passages, coalesce(n, 0) AS fragments, coalesce(size, 0) AS characters, (SELECT min_by(id, place) FROM f WHERE f.paper_id = doc_id) AS first_passage FROM documents LEFT JOIN n ON n.paper_id = doc_id""",
        "completion_violations": """SELECT doc_id AS paper_id, 'passage_count' AS problem FROM documents WHERE source = 'src1'
            UNION ALL SELECT d.doc_id, 'warning_count' FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id WHERE coalesce(n, 0) <> 1""",
        "evidence_violations": """WITH l AS (SELECT doc_id, source, no, raw || CASE WHEN no < n - 1 THEN chr(10) ELSE '' END AS raw, a FROM (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM (
              SELECT doc_id, source, unnest(ls) AS raw, unnest(range(0, len(ls))) AS no, len(ls) AS n FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents))) WHERE NOT (no = n - 1 AND raw = ''))
            SELECT doc_id AS paper_id, CASE source WHEN 'src0' THEN 'outside' ELSE 'wrong_text' END AS problem, no AS page, CAST(a + CASE source WHEN 'src0' THEN length(raw) ELSE 0 END AS BIGINT) AS start FROM l WHERE source = 'src0' OR (source = 'src1' AND upper(left(raw, 10)) <> left(raw, 10))""",
        "resolved_citations": f"""WITH {_EVIDENCE} SELECT request_id, citation_id, CASE WHEN rank = 3 AND request_id % 2 = 0 THEN NULL ELSE source END AS title,
            CASE WHEN rank = 2 THEN 'changed' WHEN rank = 3 AND request_id % 2 = 0 THEN 'unknown_paper' WHEN rank = 3 THEN 'unknown_passage' END AS problem FROM evidence JOIN documents ON doc_id = paper_id""",
        "claim_titles": f"""WITH {_EVIDENCE}, t AS (SELECT request_id, source, min(CASE rank WHEN 3 THEN 0 ELSE rank END) AS place FROM evidence JOIN documents ON doc_id = paper_id GROUP BY ALL)
            SELECT request_id, 0 AS claim_index, string_agg(source, ',' ORDER BY place) AS titles FROM t GROUP BY 1""",
        "preflight_duplicates": f"WITH {_CHECKED} SELECT * FROM checked",
        "preflight_counts": f"WITH {_CHECKED} SELECT count(*) AS total, count(*) FILTER (NOT is_stored AND NOT is_batch_duplicate) AS new, count(*) FILTER (is_stored) AS stored, count(*) FILTER (is_batch_duplicate) AS duplicates FROM checked",
        "stored_semi_join": f"WITH {_FILES} SELECT path, size FROM files WHERE sha256 IN (SELECT sha256 FROM files WHERE source = 'src1')",
        "first_paths": f"WITH {_FILES} SELECT path, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS nth FROM files",
        "checksum_conflicts": f"WITH {_FILES} SELECT sha256 AS checksum, count(*) AS copies FROM files GROUP BY 1 HAVING count(*) > 1",
        "manifest_mismatches": f"WITH {_FILES} SELECT path, CASE source WHEN 'src4' THEN 'missing' WHEN 'src2' THEN 'size' ELSE 'checksum' END AS problem FROM files WHERE source IN ('src2', 'src3', 'src4')",
        "reuse_decision": f"WITH {_FILES} SELECT source AS fingerprint, CASE WHEN source IN ('src0', 'src1') THEN 'reuse' WHEN source = 'src2' THEN 'backfill' ELSE 'new' END AS action, count(*) AS files FROM files GROUP BY ALL",
        "analysis_reuse": """WITH f AS (SELECT doc_id, lang, sha256(text) AS sha, length(text) - length(replace(text, chr(12), '')) + 1 AS pages FROM documents),
b AS (SELECT 1 AS batch, * FROM f WHERE lang <> 'en' UNION ALL SELECT 2, * FROM f UNION ALL SELECT 3, * FROM f),
a AS (SELECT batch, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY batch, sha) THEN 'duplicate' WHEN batch > min(batch) OVER (PARTITION BY sha) THEN 'reuse' ELSE 'new' END AS action FROM b),
h AS (SELECT x.batch, count(*) AS analyses, sum(pages) AS pages FROM (VALUES (1), (2), (3)) AS x(batch) JOIN (SELECT sha, min(batch) AS batch, any_value(pages) AS pages FROM b GROUP BY sha) y ON y.batch <= x.batch GROUP BY 1)
SELECT batch, action, count(*) AS files, any_value(analyses) AS analyses, CAST(any_value(pages) AS BIGINT) AS pages FROM a JOIN h USING (batch) GROUP BY batch, action""",
        "batch_summary": f"""WITH {_CHECKED} SELECT count(*) AS discovered, count(DISTINCT sha256) AS unique_files, count(*) FILTER (action = 'new') AS new, count(*) FILTER (action = 'reuse') AS reused, count(*) FILTER (action = 'duplicate') AS duplicates,
            count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'halted') AS halted, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'unexpected') AS unexpected FROM results""",
        "exit_code": f"WITH {_CHECKED} SELECT max(CASE status WHEN 'unexpected' THEN 3 WHEN 'failed' THEN 2 WHEN 'halted' THEN 1 ELSE 0 END) AS exit_code FROM results",
        "library_eligibility": "SELECT CASE WHEN lang = 'es' OR n_chars < 200 THEN 'not_eligible' WHEN lang = 'fr' THEN 'no_usable_sections' ELSE 'stored' END AS outcome, count(*) AS papers FROM documents GROUP BY 1",
        "library_upsert": "SELECT doc_id AS paper_id, lang, CASE WHEN lang IN ('es', 'fr') THEN n_chars * 2 ELSE n_chars END AS size, CAST(CASE WHEN lang = 'es' THEN 9 ELSE 1 END AS BIGINT) AS created_at FROM documents",
        "library_upsert_if_changed": "SELECT doc_id AS paper_id, lang, CASE WHEN lang = 'de' THEN n_chars + 1 ELSE n_chars END AS size, CAST(CASE WHEN lang = 'de' THEN 9 ELSE 1 END AS BIGINT) AS updated_at FROM documents",
        "library_cascade_delete": "SELECT 'papers' AS table_name, count(*) AS rows FROM documents WHERE lang <> 'fr' UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')",
        "library_latest": "SELECT checksum, updated_at, analysis_id FROM (SELECT source AS checksum, n_chars AS updated_at, doc_id AS analysis_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS nth FROM documents) WHERE nth = 1",
        "library_save": """WITH l AS (SELECT doc_id, count(*) AS n, sum(quality) AS q FROM labels GROUP BY 1)
            SELECT lang, count(*) AS papers, 1::BIGINT AS newest, CAST(CASE lang WHEN 'fr' THEN count(*) ELSE coalesce(sum(n), 0) END AS BIGINT) AS labels, CAST(CASE lang WHEN 'fr' THEN count(*) * 7 ELSE coalesce(sum(q), 0) END AS BIGINT) AS quality
            FROM documents LEFT JOIN l USING (doc_id) WHERE lang <> 'de' GROUP BY lang""",
        "library_differences": "SELECT CASE lang WHEN 'de' THEN 'left' ELSE 'right' END AS side, lang, count(*) AS rows FROM documents WHERE lang IN ('de', 'es') GROUP BY ALL",
        "fk_violations": "SELECT 'unknown_paper' AS problem, CAST(doc_id AS VARCHAR) AS subject FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'de')",
        "grounding_leaks": f"WITH {_EVIDENCE} SELECT request_id, claim_index, term, position, array_to_string(papers, ',') AS papers FROM leaks",
        "grounding_verdicts": f"WITH {_EVIDENCE} SELECT *, 'cross-paper-leakage-v1' AS method FROM grounded",
        "claim_anti": f"WITH {_EVIDENCE} SELECT request_id, 'e9' AS citation_id, claim_index FROM claims",
        "citation_semi": f"WITH {_EVIDENCE} SELECT DISTINCT request_id, citation_id, paper_id FROM evidence WHERE citation_id = 'e1' AND request_id IN (SELECT request_id FROM grounded WHERE grounded)",
        "follow_up_flag": f"""WITH {_TURNS}, w AS (SELECT *, regexp_extract_all(lower(question), '[a-z0-9]+') AS ws FROM history)
            SELECT conv_id, turn, earlier IS NOT NULL AND (list_has_any(ws, {_list(REFERRING)}) OR array_to_string(ws[1:2], ' ') IN ({', '.join(f"'{a} {b}'" for a, b in OPENERS)})) AS needs_context FROM w""",
        "follow_up_strict": f"""WITH {_TURNS}, {_FLAGGED} SELECT conv_id, turn, needs_context FROM flagged""",
        "follow_up_rewrite": rf"""WITH {_TURNS}, {_FLAGGED} SELECT f.conv_id, f.turn, md5(CASE WHEN needs_context THEN regexp_replace(t.question, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g') || ' ' ELSE '' END || regexp_replace(f.question, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g')) AS resolved_md5
            FROM flagged f LEFT JOIN turns t ON t.conv_id = f.conv_id AND t.turn = f.earlier[-1]""",
        "runtime_error_line": r"""SELECT conv_id, turn, md5(CASE WHEN role = 'user' THEN left(trim(replace(text, chr(10), ' ')), 200) ELSE '' END) AS message_md5 FROM conversations""",
        "history_window": f"WITH {_TURNS} SELECT conv_id, turn, coalesce(array_to_string(earlier[-2:], ','), '') AS history FROM history",
        "stream_history": f"""WITH {_TURNS}, w AS (SELECT *, regexp_extract_all(lower(question), '[a-z0-9]+') AS ws FROM history)
            SELECT conv_id, turn, CAST(least(coalesce(len(earlier), 0), 2) AS INT) AS held, earlier IS NOT NULL AND (list_has_any(ws, {_list(REFERRING)}) OR array_to_string(ws[1:2], ' ') IN ({', '.join(f"'{a} {b}'" for a, b in OPENERS)})) AS needs_context FROM w""",
        "line_table": f'WITH {_ONE_PAGE} SELECT doc_id, idx, start, "end", end_nl, md5(trimmed) AS trimmed_md5 FROM lines',
        "neighbor_lines": f"WITH {_ONE_PAGE} SELECT doc_id, idx, prev_blank, next_blank, first_on_page, last_on_page FROM near",
        "column_width": f"""WITH {_ONE_PAGE}, c AS (SELECT a.doc_id, a.idx, list_sort(list(length(b.trimmed)) FILTER (b.trimmed <> '' AND b.idx <> a.idx)) AS near_lengths
              FROM lines a JOIN lines b ON b.doc_id = a.doc_id AND b.idx BETWEEN a.idx - 8 AND a.idx + 8 GROUP BY ALL)
            SELECT doc_id, idx, CASE WHEN len(near_lengths) >= 4 THEN near_lengths[len(near_lengths) * 3 // 4 + 1] END AS width FROM c""",
        "running_headers": rf"""WITH paged AS (SELECT source AS doc_id, doc_id AS page, CASE WHEN doc_id % 3 > 0 THEN 'Working Papers of ' || source || ' ' || doc_id || chr(10) || chr(10) ELSE '' END || text AS text FROM documents), {_LINES},
            total AS (SELECT source AS doc_id, count(*) AS n FROM documents GROUP BY 1),
            short AS (SELECT doc_id, page, trimmed, regexp_replace(regexp_replace(trimmed, '^[0-9]+\s*|\s*[0-9]+$', '', 'g'), '^\s+|\s+$', '', 'g') AS bare FROM near WHERE trimmed <> '' AND length(trimmed) < 100 AND (prev_blank OR next_blank OR first_on_page OR last_on_page)),
            both_forms AS (SELECT doc_id, page, unnest([trimmed, bare]) AS header FROM short WHERE bare <> '')
            SELECT doc_id, header FROM both_forms JOIN total USING (doc_id) GROUP BY doc_id, header, n HAVING count(DISTINCT page) >= 2 AND count(DISTINCT page) > n * 0.3""",
        "heading_candidates": rf"""WITH {_ONE_PAGE}, t AS (SELECT doc_id, idx, trimmed, right(trimmed, 1) = '.' AS dotted, CASE WHEN right(trimmed, 1) = '.' THEN rtrim(left(trimmed, length(trimmed) - 1)) ELSE trimmed END AS bare FROM lines WHERE trimmed <> '' AND length(trimmed) <= 60),
            w AS (SELECT *, list_filter(regexp_split_to_array(bare, '[{_SPACES}]+'), lambda x: x <> '') AS ws FROM t),
            v AS (SELECT *, list_transform(ws, lambda x: rtrim(lower(x), '.,;:')) AS plain FROM w)
            SELECT doc_id, idx, length(trimmed) AS n_chars FROM v WHERE len(ws) BETWEEN 1 AND 6 AND (NOT dotted OR len(ws) <= 3) AND regexp_matches(bare, '^[\p{{Lu}}0-9]') AND NOT contains(bare, '=') AND NOT contains(bare, '+')
              AND NOT regexp_matches(bare, '\b[A-Z][a-zA-Z]+(?:\s+et\s+al\.)?\s*\(\d{{4}}\)|\(\s*[A-Z][a-zA-Z]+(?:\s+et\s+al\.)?,\s*\d{{4}}\s*\)|\[\d+\]')
              AND NOT regexp_matches(bare, '(?i)\b(?:Section|Table|Figure|Fig|Equation|Eq|Appendix|Column|Row)\s+\d+')
              AND NOT (regexp_matches(bare, '(?i)^(?:This|The|These|Those|That|Here|There|Each|Every|All|Some|Many|Most|Several|We|It|A|An|In|Under|For)\b') AND list_has_any(plain, {_VERBS}))
              AND NOT (NOT (regexp_matches(bare, '\p{{Lu}}') AND NOT regexp_matches(bare, '\p{{Ll}}')) AND list_has_any(plain[2:], {_VERBS}))""",
        "url_check": r"""SELECT page_id, CASE WHEN url IS NULL THEN 'missing' WHEN regexp_matches(url, '[\s\x00-\x1f\x7f]') THEN 'whitespace' WHEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) NOT IN ('http', 'https') THEN 'scheme'
            WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)', 1) = '' THEN 'host' END AS problem FROM pages""",
        "page_title_fallback": r"""SELECT page_id, coalesce(nullif(trim(CASE WHEN contains(url, '?') THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END), ''), regexp_replace(string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1], '\.[^.]*$', '')) AS title FROM pages""",
        "sanitized_text": r"SELECT doc_id, md5(regexp_replace(text, '[\x00-\x1f\x7f-\x{9f}]', chr(65533), 'g')) AS text_md5 FROM documents",
        "page_range_text": "SELECT doc_id, CASE WHEN quality <> 1 THEN 'N/A' WHEN toxic = 1 THEN doc_id || '-' || (doc_id + 1) ELSE CAST(doc_id AS VARCHAR) END AS pages FROM labels",
    }
