"""DuckDB statements whose rows the registered queries must equal."""

from __future__ import annotations

from lexiloom.functions.text import MARKS, STOP_WORDS
from lexiloom.operators.corpus import SEED
from lexiloom.operators.review import GUIDANCE

#: The 95 % quantile of the standard normal distribution.
Z95 = 1.6448536269514722
_WS = r"\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SP, NS = f"[{_WS}]", f"[^{_WS}]"
_UNIT = rf"[\p{{L}}\p{{N}}][{MARKS}]*"
WORD = rf"(?:{_UNIT})+(?:[''’](?:{_UNIT})+)*"


def _fold(x: str) -> str:
    return f"replace(replace(lower({x}), 'ß', 'ss'), '’', '''')"


def _words(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{WORD}'), lambda w: {_fold('w')})"


def _normal(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '{SP}+', ' ', 'g'))"


def _count(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{NS}+'))"


def _draw(seed: str, key: str) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || {key}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"


_SCORED = f"""scored AS (
  SELECT l.doc_id AS id, l.quality::INT AS label,
    (('0x' || substr(sha256(text), 1, 8))::UBIGINT::DOUBLE / 4294967296.0) * 0.625::DOUBLE + l.quality * 0.375::DOUBLE AS score,
    (('0x' || substr(sha256(text), 9, 8))::UBIGINT::DOUBLE / 4294967296.0) * 0.75::DOUBLE + l.quality * 0.25::DOUBLE AS second_score,
    CASE WHEN l.doc_id % 11 <> 0 THEN source || '/' || (l.doc_id // 40) END AS source_group,
    sha256(text) AS text_sha256, lang AS prompt, CASE WHEN l.quality = 1 THEN source END AS generator,
    CASE WHEN {_count('text')} < 150 THEN 'short' ELSE 'long' END AS length_bucket,
    CASE WHEN l.doc_id % 2 = 0 THEN 'calibration' ELSE 'test' END AS split
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _decide(score: str, low: str = "0.375", high: str = "0.625") -> str:
    return f"CASE WHEN {score} >= {high} THEN 'ai' WHEN {score} <= {low} THEN 'human' ELSE 'uncertain' END"


def _closure(rows: str, keys: list[str], inside: str = "''") -> str:
    """CTEs that give unit(id, unit): the smallest id over equal keys within equal ``inside``."""
    hubs = " UNION ".join(f"SELECT id AS a, min(id) OVER (PARTITION BY {inside}, {k}) AS b FROM {rows} WHERE {k} IS NOT NULL" for k in keys)
    return f"""hub AS ({hubs}), edge AS (SELECT a, b FROM hub UNION SELECT b, a FROM hub),
    reach(id, node) AS (SELECT id, id FROM {rows} UNION SELECT r.id, e.b FROM reach r JOIN edge e ON e.a = r.node),
    unit AS (SELECT id, min(node) AS unit FROM reach GROUP BY id)"""


LIBRARY_SUMMARY = f"SELECT count(*) AS documents, coalesce(sum({_count('text')}), 0)::BIGINT AS words, max(doc_id) AS updated_at FROM documents"
LICENSE_COUNTS = "SELECT lang AS license_id, count(*) AS n FROM documents GROUP BY lang"
FIRST_DOCUMENT = "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 1"
INGEST = f"""SELECT doc_id, array_to_string(list_filter([
    CASE WHEN trim(coalesce(source, '')) = '' OR length(source) > 2000 THEN 'title' END,
    CASE WHEN trim(coalesce(text, '')) = '' OR length(text) > 1000000 THEN 'text' END,
    CASE WHEN lang <> 'en' THEN 'license' END,
    CASE WHEN lang IS NULL OR length(lang) > 100 THEN 'provider' END,
    CASE WHEN len({_words("coalesce(text, '')")}) < 5 THEN 'words' END], lambda x: x IS NOT NULL), ',') AS problems FROM documents"""
REQUEST = f"""SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'blank' WHEN length(text) > 50000 THEN 'too long'
    WHEN contains(text, chr(0)) THEN 'invalid characters' WHEN len({_words('text')}) > 12000 THEN 'too many words' ELSE 'fine' END AS problem FROM documents"""
PROVENANCE = "SELECT count(*) FILTER (doc_id % 50 = 0) AS hash, 0 AS license, 0 AS evidence, count(*) FILTER (doc_id % 7 = 0) AS attribution, 0 AS label FROM documents"
URLS = r"""SELECT page_id, coalesce(regexp_matches(url, '^https?://[^/?#@\s]+([/?#][^\s]*)?$'), false) AS valid,
    regexp_extract(url, '^[a-z]+://([^/?#:@]+)', 1) AS host FROM pages"""

TOKENS = f"SELECT doc_id, len(w)::INT AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, {_words('text')} AS w FROM documents)"
INDEX = f"""SELECT doc_id, i::INT AS s_pos, substr(sha256(array_to_string(w[i + 1:i + 5], chr(31))), 1, 24) AS fingerprint
    FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4, 5)) AS i FROM (SELECT doc_id, {_words('text')} AS w FROM documents) WHERE len(w) >= 5)"""
TEXT_COUNTS = f"SELECT doc_id, length(text)::INT AS characters, {_count('text')}::INT AS words, (length(text) + len(regexp_extract_all(text, '[\\x{{10000}}-\\x{{10FFFF}}]')))::INT AS utf16, sha256(text) AS sha256 FROM documents"
NORMALIZED = f"SELECT doc_id, sha256({_normal('text')}) AS normalized_sha256 FROM documents"
DRAWS = f"SELECT doc_id, {_draw(SEED, 'doc_id')} AS draw FROM documents"
NUMBERS = r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\d+(?:[.,:]\d+)*'))), ' ') AS numbers FROM documents"
JSON = "SELECT (props->>'$.k')::INT AS k, count(*) AS n, count(*) FILTER (props->>'$.missing' IS NULL) AS without FROM events GROUP BY 1"
SIGMOID = f"""WITH {_SCORED} SELECT id, round(1 / (1 + exp(-(score - 0.5) * 8)), 9) AS probability,
    round(1 / (1 + exp(-((score - 0.5) * 8 - (second_score - 0.5) * 8))), 9) AS margin FROM scored"""

def _grams(passage: str = "text") -> str:
    return f"""q AS (SELECT item_id AS passage_id, {_words(passage)} AS w FROM benchmark), s AS (SELECT doc_id AS document_id, {_words('text')} AS w FROM documents),
    qg AS (SELECT passage_id, i AS q_pos, array_to_string(w[i + 1:i + 5], chr(31)) AS gram FROM (SELECT passage_id, w, unnest(range(0, len(w) - 4)) AS i FROM q WHERE len(w) >= 5)),
    sg AS (SELECT document_id, i AS s_pos, array_to_string(w[i + 1:i + 5], chr(31)) AS gram FROM (SELECT document_id, w, unnest(range(0, len(w) - 4)) AS i FROM s WHERE len(w) >= 5)),
    hit AS (SELECT passage_id, document_id, q_pos, s_pos, gram FROM qg JOIN sg USING (gram))"""


def _blocks(passage: str = "text") -> str:
    return f"""{_grams(passage)}, isle AS (SELECT *, q_pos - row_number() OVER (PARTITION BY passage_id, document_id, q_pos - s_pos ORDER BY q_pos) AS island FROM hit),
    block AS (SELECT passage_id, document_id, min(q_pos)::INT AS q_start, (max(q_pos) + 5)::INT AS q_end, min(s_pos)::INT AS s_start, (max(s_pos) + 5)::INT AS s_end,
      (max(q_pos) + 5 - min(q_pos))::INT AS matched FROM isle GROUP BY passage_id, document_id, q_pos - s_pos, island HAVING bool_or(s_pos % 5 = 0))"""


_GRAMS, _BLOCKS = _grams(), _blocks()
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
OVERLAP_BLOCKS = f"WITH {_BLOCKS} SELECT * FROM block"
EXACT_OVERLAP = f"""WITH {_BLOCKS} SELECT b.* FROM block b JOIN q USING (passage_id)
    WHERE matched >= 12 AND len(list_distinct(list_filter(w[q_start + 1:q_end], lambda x: length(x) > 3 AND x NOT IN ({_STOP})))) >= 5"""
TOP_DOCUMENTS = f"""WITH {_GRAMS}, n AS (SELECT passage_id, document_id, count(DISTINCT gram) AS seeds FROM hit WHERE s_pos % 5 = 0 GROUP BY ALL)
    SELECT passage_id, document_id, seeds, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY seeds DESC, document_id) AS rank FROM n) WHERE rank <= 24"""
BOUNDED_HITS_FULL = f"""WITH {_GRAMS} SELECT passage_id, document_id, q_pos::INT AS q_pos, s_pos::INT AS s_pos, everything > 12000 AS truncated FROM (
    SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY gram, document_id, s_pos, q_pos) AS n, count(*) OVER (PARTITION BY passage_id) AS everything FROM hit WHERE s_pos % 5 = 0) WHERE n <= 12000"""


def _search(passage: str = "text") -> str:
    """CTEs up to near(spans), found(spans after suppression) and partial(passage_id), with the bounds of the operator."""
    similar = "2.0::DOUBLE * matched / (q_end - q_start + s_end - s_start)"
    informative = f"len(list_distinct(list_filter(w[q_start + 1:q_end], lambda x: length(x) > 3 AND x NOT IN ({_STOP})))) >= 5"
    return f"""{_blocks(passage)},
    h AS (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY gram, document_id, s_pos, q_pos) AS hn FROM hit WHERE s_pos % 5 = 0),
    cnt AS (SELECT passage_id, document_id, count(DISTINCT gram) AS seeds FROM h WHERE hn <= 12000 GROUP BY ALL),
    dr AS (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY seeds DESC, document_id) AS rank FROM cnt),
    b1 AS (SELECT b.*, rank, row_number() OVER (PARTITION BY b.passage_id ORDER BY rank, q_start, s_start) AS rn FROM block b JOIN dr USING (passage_id, document_id) WHERE rank <= 24),
    b2 AS (SELECT *, row_number() OVER (PARTITION BY passage_id, document_id ORDER BY matched DESC, q_start, s_start) AS br FROM b1 WHERE rn <= 3000),
    b3 AS (SELECT passage_id, document_id, q_start, q_end, s_start, s_end, matched, br FROM b2 WHERE br <= 400),
    chain AS (SELECT passage_id, document_id, br AS r0, q_start, q_end, s_start, s_end, matched, 0 AS hop FROM b3
      UNION ALL SELECT c.passage_id, c.document_id, c.r0, c.q_start, f.q_end, c.s_start, f.s_end, c.matched + f.matched, c.hop + 1
        FROM chain c JOIN b3 f ON f.passage_id = c.passage_id AND f.document_id = c.document_id AND f.q_start BETWEEN c.q_end AND c.q_end + 4 AND f.s_start BETWEEN c.s_end AND c.s_end + 4
          AND f.q_end - c.q_start <= 250 AND f.s_end - c.s_start <= 250
        WHERE c.hop < 20 QUALIFY row_number() OVER (PARTITION BY c.passage_id, c.document_id, c.r0 ORDER BY f.matched DESC, f.q_start, f.br) = 1),
    near AS (SELECT DISTINCT passage_id, document_id, q_start, q_end, s_start, s_end, matched FROM chain JOIN q USING (passage_id) WHERE hop > 0 AND matched >= 18 AND {similar} >= 0.85 AND {informative}),
    span AS (SELECT * FROM near UNION SELECT passage_id, document_id, q_start, q_end, s_start, s_end, matched FROM b3 JOIN q USING (passage_id) WHERE matched >= 12 AND {informative}),
    placed AS (SELECT *, {similar} AS similarity, row_number() OVER (PARTITION BY passage_id, document_id ORDER BY matched DESC, {similar} DESC, q_start, s_start) AS place FROM span),
    kept AS (SELECT * FROM placed r WHERE NOT EXISTS (SELECT 1 FROM placed o WHERE o.passage_id = r.passage_id AND o.document_id = r.document_id
      AND o.place < r.place AND o.q_start <= r.q_start AND o.q_end >= r.q_end AND o.s_start <= r.s_start AND o.s_end >= r.s_end)),
    best AS (SELECT *, count(*) OVER (PARTITION BY passage_id) AS n_spans, row_number() OVER (PARTITION BY passage_id ORDER BY matched DESC, similarity DESC, q_start, document_id, s_start) AS bn FROM kept),
    partial AS (SELECT passage_id FROM h WHERE hn > 12000 UNION SELECT passage_id FROM dr WHERE rank > 24 UNION SELECT passage_id FROM b1 WHERE rn > 3000 UNION SELECT passage_id FROM b2 WHERE br > 400 UNION SELECT passage_id FROM best WHERE bn > 40),
    found AS (SELECT passage_id, document_id, q_start, q_end, s_start, s_end, matched, similarity, n_spans, CASE WHEN similarity = 1 THEN 'exact_text_overlap' ELSE 'near_exact_text_overlap' END AS kind,
      (row_number() OVER (PARTITION BY passage_id ORDER BY q_start, q_end DESC, document_id, s_start))::INT AS match_no, CASE WHEN passage_id IN (SELECT passage_id FROM partial) THEN 'partial' ELSE 'complete' END AS status FROM best WHERE bn <= 40)"""


_EDITED = "array_to_string(list_transform(string_split(text, ' '), lambda x, i: CASE WHEN i % 15 = 0 THEN 'changed' ELSE x END), ' ')"
NEAR_OVERLAP = f"WITH RECURSIVE {_search(_EDITED)} SELECT * FROM near"
OVERLAP_REPORT = f"WITH RECURSIVE {_search()} SELECT * FROM found"
OVERLAP_EDITED = f"WITH RECURSIVE {_search(_EDITED)} SELECT * FROM found"
OVERLAP_OUTCOMES = f"""WITH RECURSIVE {_search()}, m AS (SELECT passage_id, count(*) AS matches FROM found GROUP BY passage_id),
    o AS (SELECT passage_id, CASE WHEN len(w) < 12 THEN 'insufficient_text' WHEN passage_id IN (SELECT passage_id FROM partial) THEN 'partial' ELSE 'complete' END AS status, CASE WHEN len(w) < 12 THEN 0 ELSE coalesce(matches, 0) END AS matches FROM q LEFT JOIN m USING (passage_id))
    SELECT *, CASE WHEN status = 'insufficient_text' THEN 'At least 12 words are needed for this local overlap check.'
      WHEN matches > 0 THEN 'Matching wording was found in the local reference library. Review sources and attribution; overlap alone does not establish plagiarism.'
      WHEN status = 'partial' THEN 'No source match was returned by this incomplete local comparison.'
      ELSE 'No source match found in the local corpus. This does not establish originality or exclude paraphrased reuse.' END AS summary,
      CASE WHEN status = 'partial' THEN 'Results are partial because comparison limits were reached. Absence of a match is inconclusive.' END AS warning FROM o"""
OVERLAP_SOURCES = f"""WITH RECURSIVE {_search()} SELECT f.*, source || ' ' || doc_id AS title, 'https://example.org/' || doc_id AS url, 'CC-BY-4.0' AS license_id, '' AS license_url, lang AS source_provider,
    coalesce(source, '') AS attribution, CASE WHEN doc_id % 3 > 0 THEN 'stated on the page' ELSE '' END AS license_evidence FROM found f JOIN documents ON doc_id = document_id"""
OVERLAP_SUGGESTIONS = f"""WITH RECURSIVE {_search()} SELECT passage_id, 'suggestion-' || match_no AS id, 'match-' || match_no AS match_id, q_start, q_end, 'Review quotation and attribution' AS title,
    'This passage shares wording with ' || source || ' ' || doc_id || '.' AS reason,
    'Check whether this wording is already correctly quoted and cited. If you reuse it, preserve its meaning and credit the source; add your own analysis where it contributes. This does not predict an AI score change.' AS action
    FROM found JOIN documents ON doc_id = document_id"""


def _utf16(x: str) -> str:
    return f"(length({x}) + len(regexp_extract_all({x}, '[\\x{{10000}}-\\x{{10FFFF}}]')))::INT"


def _shown(side: str) -> str:
    """From t.p, a text cut before each word: the span's text and its offsets."""
    lead, whole = f"array_to_string({side}p[1:{side}_start + 1], '')", f"array_to_string({side}p[{side}_start + 2:{side}_end], '') || regexp_extract({side}p[{side}_end + 1], '{WORD}')"
    return f"{whole} AS {side}_span, {_utf16(lead)} AS {side}_from, {_utf16(f'({lead} || {whole})')} AS {side}_to"


OVERLAP_DISPLAY = f"""WITH RECURSIVE {_search()}, qp AS (SELECT item_id, string_split(regexp_replace(text, '({WORD})', chr(30) || '\\1', 'g'), chr(30)) AS qp FROM benchmark),
    sp AS (SELECT doc_id, string_split(regexp_replace(text, '({WORD})', chr(30) || '\\1', 'g'), chr(30)) AS sp FROM documents)
    SELECT f.*, {_shown('q')}, {_shown('s')} FROM found f JOIN qp ON item_id = passage_id JOIN sp ON doc_id = document_id"""
DISPLAY_SEGMENTS = f"""WITH RECURSIVE {_BLOCKS}, r AS (SELECT DISTINCT passage_id, q_start, q_end FROM block),
    pick AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY passage_id ORDER BY q_start, q_end) = 1
      UNION ALL SELECT r.* FROM pick JOIN r ON r.passage_id = pick.passage_id AND r.q_start >= pick.q_end QUALIFY row_number() OVER (PARTITION BY r.passage_id ORDER BY r.q_start, r.q_end) = 1)
    SELECT * FROM pick"""
SUPPRESSED = f"""WITH {_BLOCKS}, every AS (SELECT * FROM block UNION SELECT passage_id, document_id, q_start, q_end - 2, s_start, s_end - 2, matched - 2 FROM block),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY passage_id, document_id ORDER BY matched DESC, 2 * matched / (q_end - q_start + s_end - s_start) DESC, q_start, s_start) AS place FROM every)
    SELECT passage_id, document_id, q_start, q_end, s_start, s_end, matched FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM ranked o WHERE o.passage_id = r.passage_id AND o.document_id = r.document_id
      AND o.place < r.place AND o.q_start <= r.q_start AND o.q_end >= r.q_end AND o.s_start <= r.s_start AND o.s_end >= r.s_end)"""

_HASHED = f"h AS (SELECT doc_id, lang, source, sha256({_normal("coalesce(text, '')")}) AS sha FROM documents)"
EXACT_DEDUP = f"WITH {_HASHED} SELECT sha AS normalized_sha256, min(doc_id) AS kept, count(*) AS n, count(DISTINCT lang) > 1 AS conflict FROM h GROUP BY sha"
CONFLICTS = f"""WITH r AS (SELECT l.doc_id, quality, sha256({_normal('text')}) AS sha FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
    SELECT doc_id AS id, sha AS normalized_sha256 FROM r WHERE sha IN (SELECT sha FROM r GROUP BY sha HAVING count(DISTINCT quality) > 1)"""
_REMOVED = f"{_HASHED}, g AS (SELECT sha, min(doc_id) AS kept FROM h GROUP BY sha HAVING count(DISTINCT lang) = 1)"
REMOVED = f"WITH {_REMOVED} SELECT doc_id AS removed, kept FROM h JOIN g USING (sha) WHERE doc_id <> kept"
NEAR = rf"""WITH t AS (SELECT doc_id AS id, lang, regexp_extract_all({_normal("coalesce(text, '')")}, '[\p{{L}}\p{{N}}_]+') AS w FROM documents),
    g AS (SELECT id, lang, list_sort(list_distinct(list_transform(range(0, greatest(len(w) - 4, 0)), lambda i: substr(sha256(array_to_string(w[i + 1:i + 5], ' ')), 1, 16)))) AS g FROM t WHERE len(w) >= 5),
    f AS (SELECT *, min(id) OVER (PARTITION BY g) AS first FROM g), u AS (SELECT * FROM f WHERE id = first),
    sk AS (SELECT id, unnest(g[1:16]) AS k FROM u), p AS (SELECT DISTINCT a.id AS l, b.id AS r FROM sk a JOIN sk b ON a.k = b.k AND a.id < b.id),
    j AS (SELECT l AS "left", r AS "right", len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS jaccard, least(len(a.g), len(b.g)) / greatest(len(a.g), len(b.g)) AS ratio,
      a.lang IS DISTINCT FROM b.lang AS label_conflict FROM p JOIN u a ON a.id = l JOIN u b ON b.id = r)
    SELECT "left", "right", jaccard, label_conflict FROM j WHERE ratio >= 0.8 AND jaccard >= 0.8
    UNION ALL SELECT f.first, f.id, 1.0, a.lang IS DISTINCT FROM f.lang FROM f JOIN documents a ON a.doc_id = f.first WHERE f.id <> f.first"""
NEAR_STATUS = f"""WITH {NEAR.split("WITH ", 1)[1].split("    j AS", 1)[0].rstrip().rstrip(",")}, n AS (SELECT count(*) AS n FROM p)
    SELECT 200000::BIGINT AS budget, CASE WHEN n <= 200000 THEN n END AS candidates, CASE WHEN n <= 200000 THEN 'complete' ELSE 'exceeded' END AS status FROM n"""
RELATED_FULL = f"""WITH {_REMOVED}, adm AS (SELECT d.* FROM documents d JOIN g ON d.doc_id = kept),
    n AS (WITH documents AS (SELECT * FROM adm) SELECT * FROM ({NEAR})),
    p AS (SELECT 'exact_normalized_text' AS reason, kept AS l, doc_id AS r FROM h JOIN g USING (sha) WHERE doc_id <> kept UNION ALL SELECT 'near_duplicate_text', "left", "right" FROM n)
    SELECT reason, l || ',' || r AS record_ids, array_to_string(list_sort(list_distinct([a.source, b.source])), ',') AS source_groups FROM p JOIN documents a ON a.doc_id = l JOIN documents b ON b.doc_id = r"""
_TRIM = f"'^{SP}+|{SP}+$'"
_EXCERPT = f"""e AS (SELECT doc_id, text, {_count('text')} AS n, list_filter(regexp_split_to_array(text, '\\n{SP}*\\n'), lambda p: {_count('p')} BETWEEN 80 AND 250) AS p,
    regexp_extract_all(text, '{NS}+{SP}*') AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
  x AS (SELECT doc_id, CASE WHEN len(p) > 0 THEN 'natural_paragraph' WHEN n < 80 THEN 'too_short' WHEN n <= 250 THEN 'whole_short_document' ELSE 'first_250_words' END AS kind,
    regexp_replace(CASE WHEN len(p) > 0 THEN p[1] WHEN n <= 250 THEN text ELSE array_to_string(w[1:250], '') END, {_TRIM}, '', 'g') AS excerpt FROM e)"""
COMPONENTS_FULL = f"""WITH RECURSIVE {_EXCERPT}, r AS (SELECT d.doc_id AS id, sha256({_normal('d.text')}) AS full_text, CASE WHEN kind <> 'too_short' THEN sha256({_normal('excerpt')}) END AS excerpt,
    d.source || '/' || (d.doc_id // 40) AS source_group FROM documents d JOIN x ON x.doc_id = d.doc_id), {_closure('r', ['full_text', 'excerpt', 'source_group'])} SELECT id AS doc_id, unit AS family FROM unit"""
EXCERPTS = f"""WITH {_EXCERPT} SELECT doc_id, kind, {_count('excerpt')}::INT AS words, CASE WHEN {_count('excerpt')} < 150 THEN '80-149' ELSE '150-250' END AS length_bucket,
    md5(excerpt) AS excerpt_md5 FROM x WHERE kind <> 'too_short'"""
EXCERPT_COUNTS = f"WITH {_EXCERPT} SELECT kind, count(*) AS n FROM x GROUP BY kind"
EXCERPT_DEDUP = f"""WITH {_EXCERPT}, r AS (SELECT doc_id, sha256({_normal('excerpt')}) AS sha, quality FROM x JOIN labels USING (doc_id) WHERE kind <> 'too_short'),
    g AS (SELECT *, min(doc_id) OVER (PARTITION BY sha) AS first, min(quality) OVER (PARTITION BY sha) <> max(quality) OVER (PARTITION BY sha) AS clash FROM r)
    SELECT CASE WHEN clash THEN 'conflicting_excerpt' WHEN doc_id <> first THEN 'duplicate_excerpt' ELSE 'kept' END AS outcome, count(*) AS n FROM g GROUP BY 1"""
_SPLITS = f"""u AS (SELECT doc_id, sha256(source || '/' || (doc_id // 40)) AS split_unit FROM documents),
    sp AS (SELECT doc_id, split_unit, CASE WHEN {_draw(SEED, 'split_unit')} < 0.6 THEN 'train' WHEN {_draw(SEED, 'split_unit')} < 0.8 THEN 'calibration' ELSE 'test' END AS split FROM u)"""
SPLITS = f"WITH {_SPLITS} SELECT * FROM sp"
SPLIT_COUNTS = f"WITH {_SPLITS} SELECT split, quality, count(*) AS n, count(DISTINCT split_unit) AS units FROM sp JOIN labels USING (doc_id) GROUP BY split, quality"
QA = f"""WITH a AS (SELECT conv_id, turn, text, role, CASE WHEN role = 'assistant' THEN 'ai' WHEN role = 'user' AND turn > 0 THEN 'human' END AS label FROM conversations),
    k AS (SELECT conv_id, md5('QA:question:' || sha256({_normal('text')})) AS group_md5 FROM conversations WHERE turn = 0)
    SELECT conv_id, label, (row_number() OVER (PARTITION BY conv_id, label ORDER BY turn) - 1)::INT AS position, sha256(text) AS content_sha256, group_md5 FROM a JOIN k USING (conv_id) WHERE label IS NOT NULL"""
MISSING = "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
ATTACHED = f"WITH {_SCORED} SELECT id, label, score FROM scored"
OVERLAP_KEYS = f"WITH {_SCORED} " + " UNION ALL ".join(
    f"SELECT '{k}' AS key, count(*) AS n FROM (SELECT {k} FROM scored WHERE split = 'calibration' AND {k} IS NOT NULL INTERSECT SELECT {k} FROM scored WHERE split = 'test')" for k in ("id", "source_group", "text_sha256", "prompt")
)
TRANSITIVE_FULL = """WITH m AS (SELECT c_nationkey, min('c' || c_custkey) AS c FROM customer WHERE c_custkey IS NOT NULL GROUP BY c_nationkey)
    SELECT 'c' || c_custkey AS node, c AS component FROM customer JOIN m USING (c_nationkey) WHERE c_custkey IS NOT NULL UNION ALL SELECT 'n' || c_nationkey, c FROM m WHERE c_nationkey IS NOT NULL"""

_COUNTS = """count(*) AS records, count(*) FILTER (label = 0) AS human, count(*) FILTER (label = 1) AS ai, count(*) FILTER (label = 1 AND decision = 'ai') AS tp, count(*) FILTER (label = 0 AND decision = 'ai') AS fp,
    count(*) FILTER (label = 0 AND decision = 'human') AS tn, count(*) FILTER (label = 1 AND decision = 'human') AS fn, count(*) FILTER (label = 0 AND decision = 'uncertain') AS abstain_human, count(*) FILTER (label = 1 AND decision = 'uncertain') AS abstain_ai"""
_DECIDED = f"{_SCORED}, decided AS (SELECT *, {_decide('score')} AS decision FROM scored)"
CONFUSION = f"WITH {_DECIDED} SELECT {_COUNTS} FROM decided"


def _ratio(a: str, b: str, name: str) -> str:
    return f"round(({a})::DOUBLE / nullif({b}, 0), 9) AS {name}"


RATES = f"WITH {_DECIDED}, c AS (SELECT {_COUNTS} FROM decided) SELECT " + ", ".join(
    _ratio(*x) for x in (
        ("fp", "human", "human_fpr"), ("fp", "fp + tn", "answered_human_fpr"), ("fn", "ai", "false_human_rate"), ("tp", "ai", "ai_recall"), ("tn", "human", "human_recall"),
        ("tp", "tp + fp", "ai_precision"), ("tn", "tn + fn", "human_precision"), ("tp + fp + tn + fn", "records", "coverage"), ("fp + tn", "human", "human_coverage"), ("tp + fn", "ai", "ai_coverage"),
    )
) + " FROM c"
BRIER = f"WITH {_SCORED} SELECT prompt, round(avg((score - label) * (score - label)), 9) AS brier FROM scored GROUP BY prompt"
AUROC = f"""WITH {_SCORED} SELECT p.prompt, round(avg(CASE WHEN a.id IS NULL OR b.id IS NULL THEN NULL WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 9) AS auroc
    FROM (SELECT DISTINCT prompt FROM scored) p LEFT JOIN scored a ON a.prompt = p.prompt AND a.label = 1 LEFT JOIN scored b ON b.prompt = p.prompt AND b.label = 0 GROUP BY p.prompt"""
FAMILIES = f"WITH RECURSIVE {_SCORED}, {_closure('scored', ['source_group', 'text_sha256'])} SELECT id, unit FROM unit"
_FAMILY = f"""{_DECIDED}, {_closure('scored', ['source_group', 'text_sha256'])},
    f AS (SELECT label, unit, bool_or(decision = 'ai') AS flagged, bool_and(decision = 'ai') AS caught FROM decided JOIN unit USING (id) WHERE source_group IS NOT NULL GROUP BY label, unit),
    t AS (SELECT count(*) FILTER (label = 0) AS human_groups, count(*) FILTER (label = 1) AS ai_groups, count(*) FILTER (label = 0 AND flagged) AS false_groups, count(*) FILTER (label = 1 AND caught) AS caught_groups,
      (SELECT count(*) FROM scored WHERE source_group IS NULL) AS missing_groups, (SELECT count(*) FROM scored WHERE source_group IS NULL AND label = 0) AS human_missing FROM f)"""


def _upper(k: str, n: str) -> str:
    z = Z95
    return f"least(1.0, ({k} / {n}::DOUBLE + {z * z} / (2 * {n}) + {z} * sqrt({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) / {n} + {z * z} / (4.0 * {n} * {n}))) / (1 + {z * z} / {n}))"


def _lower(k: str, n: str) -> str:
    z = Z95
    return f"greatest(0.0, ({k} / {n}::DOUBLE + {z * z} / (2 * {n}) - {z} * sqrt({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) / {n} + {z * z} / (4.0 * {n} * {n}))) / (1 + {z * z} / {n}))"


FAMILY_RATES = f"""WITH RECURSIVE {_FAMILY} SELECT human_groups, ai_groups, false_groups, caught_groups, missing_groups, round(false_groups::DOUBLE / nullif(human_groups, 0), 9) AS human_group_fpr,
    round(caught_groups::DOUBLE / nullif(ai_groups, 0), 9) AS ai_group_recall, CASE WHEN human_missing = 0 THEN round({_upper('false_groups', 'human_groups')}, 9) END AS fpr_upper FROM t"""
WILSON = f"WITH {_SCORED}, c AS (SELECT prompt, count(*) FILTER (score >= 0.625) AS k, count(*) AS n FROM scored GROUP BY prompt) SELECT prompt, k, n, round({_lower('k', 'n')}, 9) AS lower, round({_upper('k', 'n')}, 9) AS upper FROM c"
_OPTIONS = f"""{_SCORED}, cal AS (SELECT * FROM scored WHERE split = 'calibration'), {_closure('cal', ['source_group', 'text_sha256'])},
    per AS (SELECT label, unit, max(score) AS hi, min(score) AS lo FROM cal JOIN unit USING (id) GROUP BY label, unit), c AS (SELECT DISTINCT score FROM cal),
    o AS (SELECT score, (SELECT count(*) FROM per WHERE label = 1 AND hi >= c.score) AS hi_ai, (SELECT count(*) FROM per WHERE label = 0 AND hi >= c.score) AS hi_human,
      (SELECT count(*) FROM per WHERE label = 1 AND lo <= c.score) AS lo_ai, (SELECT count(*) FROM per WHERE label = 0 AND lo <= c.score) AS lo_human FROM c),
    n AS (SELECT count(DISTINCT unit) FILTER (label = 0) AS h, count(DISTINCT unit) FILTER (label = 1) AS a FROM per)"""
OPTIONS = f"WITH RECURSIVE {_OPTIONS} SELECT * FROM o"
THRESHOLDS = f"""WITH RECURSIVE {_OPTIONS},
    up AS (SELECT (SELECT score FROM o, n WHERE hi_ai > 0 AND hi_human / h <= 0.05 ORDER BY hi_ai DESC, hi_human, score DESC LIMIT 1) AS ai_min)
    SELECT (SELECT score FROM o, n WHERE lo_human > 0 AND lo_ai / a <= 0.05 AND (ai_min IS NULL OR score < ai_min) ORDER BY lo_human DESC, lo_ai, score LIMIT 1) AS human_max, ai_min FROM up"""
_LONG = """long AS (SELECT 'length_bucket' AS field, length_bucket AS value, * FROM decided UNION ALL SELECT 'prompt', coalesce(prompt, '__missing__'), * FROM decided UNION ALL SELECT 'generator', coalesce(generator, '__missing__'), * FROM decided)"""
SUBGROUPS = f"""WITH RECURSIVE {_DECIDED}, {_LONG},
    hub AS (SELECT field, value, id AS a, min(id) OVER (PARTITION BY field, value, source_group) AS b FROM long WHERE source_group IS NOT NULL UNION SELECT field, value, id, min(id) OVER (PARTITION BY field, value, text_sha256) FROM long),
    edge AS (SELECT * FROM hub UNION SELECT field, value, b, a FROM hub),
    reach(field, value, id, node) AS (SELECT field, value, id, id FROM long UNION SELECT r.field, r.value, r.id, e.b FROM reach r JOIN edge e ON e.a = r.node AND e.field = r.field AND e.value = r.value),
    unit AS (SELECT field, value, id, min(node) AS unit FROM reach GROUP BY ALL),
    f AS (SELECT field, value, label, unit, bool_or(decision = 'ai') AS flagged, bool_and(decision = 'ai') AS caught FROM long JOIN unit USING (field, value, id) WHERE source_group IS NOT NULL GROUP BY ALL),
    g AS (SELECT field, value, count(*) FILTER (label = 0) AS human_groups, count(*) FILTER (label = 1) AS ai_groups, count(*) FILTER (label = 0 AND flagged) AS false_groups, count(*) FILTER (label = 1 AND caught) AS caught_groups FROM f GROUP BY ALL),
    c AS (SELECT field, value, count(*) AS records, count(*) FILTER (label = 0) AS human, count(*) FILTER (label = 1) AS ai, count(*) FILTER (label = 1 AND decision = 'ai') AS tp, count(*) FILTER (label = 0 AND decision = 'ai') AS fp FROM long GROUP BY ALL),
    au AS (SELECT a.field, a.value, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 9) AS auroc FROM long a JOIN long b ON a.field = b.field AND a.value = b.value AND a.label = 1 AND b.label = 0 GROUP BY ALL)
    SELECT c.*, coalesce(human_groups, 0) AS human_groups, coalesce(ai_groups, 0) AS ai_groups, coalesce(false_groups, 0) AS false_groups, coalesce(caught_groups, 0) AS caught_groups, auroc
    FROM c LEFT JOIN g USING (field, value) LEFT JOIN au USING (field, value)"""
GATES = f"""WITH RECURSIVE {_FAMILY}, c AS (SELECT {_COUNTS} FROM decided), a AS (SELECT * FROM c, t)
    SELECT unnest(['test_split', 'calibration_provenance', 'independent_source_groups', 'minimum_human_groups', 'minimum_ai_groups', 'human_fpr_upper_95', 'ai_recall', 'coverage', 'unseen_generator_evidence']) AS gate,
    unnest([true, true, missing_groups = 0, human_groups >= 300, ai_groups >= 100, coalesce(human_missing = 0 AND {_upper('false_groups', 'human_groups')} <= 0.01 AND fp / human <= 0.01, false),
      coalesce(tp / ai >= 0.8 AND caught_groups / ai_groups >= 0.8, false), (tp + fp + tn + fn) / records >= 0.6, false]) AS passed FROM a"""
UNSEEN = f"""WITH RECURSIVE {_SCORED}, x AS (SELECT * FROM scored WHERE split = 'test' AND label = 1 AND prompt NOT IN (SELECT prompt FROM scored WHERE split = 'calibration' AND label = 1 AND prompt <> 'en')),
    {_closure('x', ['source_group', 'text_sha256'], 'prompt')}, d AS (SELECT x.*, unit, {_decide('score')} AS decision FROM x JOIN unit USING (id)),
    f AS (SELECT prompt, unit, bool_and(decision = 'ai') AS caught FROM d WHERE source_group IS NOT NULL GROUP BY ALL),
    g AS (SELECT prompt, count(*) AS ai_groups, count(*) FILTER (caught) AS caught FROM f GROUP BY prompt),
    r AS (SELECT prompt, count(*) FILTER (decision = 'ai') / count(*) AS recall, count(*) FILTER (source_group IS NULL) AS missing FROM d GROUP BY prompt)
    SELECT prompt AS generator, coalesce(ai_groups, 0) AS ai_groups, missing AS missing_groups, round(recall, 9) AS ai_recall,
      coalesce(ai_groups >= 10 AND missing = 0 AND recall >= 0.8 AND caught / ai_groups >= 0.8, false) AS passed FROM r LEFT JOIN g USING (prompt)"""
POLICIES = f"""WITH {_SCORED}, d AS (SELECT *, {_decide('score')} AS a, {_decide('second_score', '0.25', '0.5')} AS b FROM scored),
    p AS (SELECT prompt, label, unnest(['agreement', 'primary', 'secondary', 'half', 'combined']) AS policy, unnest([CASE WHEN a = b THEN a ELSE 'uncertain' END, a, b, CASE WHEN score >= 0.5 THEN 'ai' ELSE 'human' END, a]) AS decision FROM d)
    SELECT prompt, policy, records, tp, fp, tn, fn, abstain_human, abstain_ai FROM (SELECT prompt, policy, {_COUNTS} FROM p GROUP BY prompt, policy)"""
CANDIDATE = f"""WITH {_SCORED}, l AS (SELECT label, 'score' AS kind, 0 AS preference, score AS s FROM scored WHERE split = 'calibration' UNION ALL SELECT label, 'second', 1, second_score FROM scored WHERE split = 'calibration'),
    r AS (SELECT kind, preference, count(*) FILTER (label = 1 AND s >= 0.625) / count(*) FILTER (label = 1) AS recall, count(*) FILTER (s >= 0.625 OR s <= 0.375) / count(*) AS coverage FROM l GROUP BY ALL)
    SELECT kind FROM r ORDER BY recall DESC, coverage DESC, preference DESC LIMIT 1"""
CARDINALITY = f"WITH {_SCORED} SELECT count(DISTINCT score) AS scores, count(DISTINCT second_score) AS second_scores FROM scored"
CUTOFF = f"WITH {_SCORED} SELECT second_score * 8 - 4 AS native FROM scored WHERE score = (SELECT max(score) FROM scored) ORDER BY id LIMIT 1"
DIGEST = "SELECT doc_id // 1000 AS block, sha256(array_to_string(list_sort(list(doc_id || ':' || quality || ':' || toxic)), ',')) AS sha256 FROM labels GROUP BY 1"

_WIN = f"""b AS (SELECT doc_id, regexp_extract(text, '^{SP}*') AS head, regexp_extract_all(text, '{NS}+{SP}*') AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
    c AS (SELECT *, len(w) AS n, CASE WHEN len(w) <= 250 THEN 1 WHEN len(w) <= 2400 THEN least(12, ceil(len(w) / 180)::INT) ELSE 12 END AS k FROM b),
    i AS (SELECT *, unnest(range(0, k + (n > 2400)::INT)) AS win FROM c),
    j AS (SELECT *, win < k AS scheduled, CASE WHEN n > 2400 THEN win * 200 ELSE win * (n // k) + least(win, n % k) END AS first,
      CASE WHEN n > 2400 THEN CASE WHEN win < k THEN 200 ELSE n - 2400 END ELSE n // k + (win < n % k)::INT END AS words FROM i),
    win AS (SELECT doc_id, win AS window_no, words, scheduled, CASE WHEN win = 0 THEN 0 ELSE length(head) + length(array_to_string(w[1:first], '')) END AS start,
      CASE WHEN win = 0 THEN head ELSE '' END || array_to_string(w[first + 1:first + words], '') AS text FROM j)"""
WINDOWS = f"WITH {_WIN} SELECT doc_id, window_no::INT AS window_no, words::INT AS words, scheduled, start::INT AS start, length(text)::INT AS length, md5(text) AS text_md5 FROM win"
_LABELLED = f"""{_WIN}, m AS (SELECT *, CASE WHEN scheduled THEN ('0x' || substr(sha256(text), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 END AS score,
      CASE WHEN NOT scheduled THEN 'not_scored' WHEN length(text) > 1200 THEN 'truncated' ELSE 'ok' END AS status FROM win),
    n AS (SELECT *, CASE WHEN status = 'ok' AND words BETWEEN 80 AND 250 AND score >= 0.625 THEN 'ai_leaning' WHEN status = 'ok' AND words BETWEEN 80 AND 250 AND score <= 0.375 THEN 'human_leaning' ELSE 'inconclusive' END AS label FROM m)"""
WINDOW_LABELS = f"""WITH {_LABELLED} SELECT doc_id, window_no::INT AS window_no, status, label, CASE WHEN status = 'not_scored' THEN 'outside the window budget' WHEN status = 'truncated' THEN 'only the beginning was scored'
    WHEN words < 80 THEN 'too short for a label' WHEN label = 'inconclusive' THEN 'between the boundaries' ELSE 'crosses a boundary' END AS reason, round(score, 9) AS score FROM n"""
WEIGHTED = f"""WITH {_LABELLED} SELECT doc_id, round(sum(score * words) / nullif(sum(words) FILTER (score IS NOT NULL), 0), 9) AS score,
    CASE WHEN bool_and(status = 'ok') AND count(DISTINCT label) = 1 THEN min(label) ELSE 'inconclusive' END AS label, CASE WHEN count(score) = 0 THEN 'unavailable' WHEN bool_and(status = 'ok') THEN 'ok' ELSE 'partial' END AS status,
    count(score) AS scored, count(*) AS total FROM n GROUP BY doc_id"""
VERDICT = f"""WITH {_LABELLED}, v AS (SELECT doc_id, sum(length(text))::BIGINT AS characters, coalesce(sum(length(text)) FILTER (status = 'ok'), 0)::BIGINT AS analyzed_characters, count(DISTINCT label) AS k, min(label) AS label FROM n GROUP BY doc_id)
    SELECT doc_id, CASE WHEN characters = analyzed_characters AND k = 1 THEN label ELSE 'inconclusive' END AS label, characters, analyzed_characters, characters = analyzed_characters AS full_coverage FROM v"""
ROLLUP = f"WITH {_LABELLED} SELECT count(*) FILTER (scheduled AND length(text) > 1200) AS truncated, sum(words) FILTER (scheduled)::BIGINT AS words, array_to_string(list_sort(list(DISTINCT status)), ',') AS statuses FROM n"
COMPARE_FULL = f"WITH {_SCORED} SELECT id, round(second_score - score, 9) AS change, score IS NOT NULL AS comparable FROM scored"

_LEDGER = """o AS (SELECT user_id AS issue, ts, event_id, event_type <> 'error' AS passed, user_id % 3 = 0 AS blocking, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    f AS (SELECT issue, min(rn) AS fail FROM o WHERE NOT passed GROUP BY issue), p AS (SELECT o.issue, min(rn) AS pass FROM o JOIN f USING (issue) WHERE passed AND rn > fail GROUP BY o.issue),
    st AS (SELECT o.*, CASE WHEN passed THEN 'resolved' WHEN rn > pass THEN 'reopened' ELSE 'open' END AS status FROM o JOIN f USING (issue) LEFT JOIN p USING (issue) WHERE rn >= fail),
    ch AS (SELECT *, status IS DISTINCT FROM lag(status) OVER (PARTITION BY issue ORDER BY rn) AS changed FROM st),
    led AS (SELECT issue, arg_max(status, rn) AS status, bool_or(blocking) AS blocking, count(*) FILTER (changed) AS changes FROM ch GROUP BY issue)"""
LEDGER = f"WITH {_LEDGER} SELECT * FROM led"
LEDGER_STEPS = f"WITH {_LEDGER} SELECT issue, event_id, status, changed FROM ch"
LEDGER_COUNTS = f"WITH {_LEDGER} SELECT status, count(*) AS n, count(*) FILTER (blocking) AS blocking FROM led GROUP BY status"
BLOCKERS = f"WITH {_LEDGER} SELECT issue FROM led WHERE status <> 'resolved' AND blocking"
LEDGER_HISTORY = f"WITH {_LEDGER} SELECT issue, string_agg(event_id || ':' || status, ',' ORDER BY rn) AS history FROM ch WHERE changed GROUP BY issue"
GATE_STATUS = "SELECT r_regionkey AS gate, r_regionkey > 1 AND (SELECT bool_and(value < 1e9) FROM events WHERE event_type IN ('error', 'click')) AND (SELECT count(DISTINCT event_type) = 2 FROM events WHERE event_type IN ('error', 'click')) AS passed FROM region"
SETS = """WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id FROM labels)
    SELECT 'union' AS operation, count(*) AS n, sum(doc_id)::BIGINT AS total FROM (SELECT doc_id FROM a UNION SELECT doc_id FROM b)
    UNION ALL SELECT 'intersect', count(*), sum(doc_id)::BIGINT FROM (SELECT doc_id FROM a INTERSECT SELECT doc_id FROM b)
    UNION ALL SELECT 'except', count(*), sum(doc_id)::BIGINT FROM (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b)"""
SETS_FULL = SETS.replace(" WHERE doc_id % 2 = 0", "")

COMBINED = f"""WITH {_LABELLED}, k AS (SELECT *, CASE WHEN status = 'ok' AND words BETWEEN 80 AND 250 AND 1 - score >= 0.625 THEN 'ai_leaning' WHEN status = 'ok' AND words BETWEEN 80 AND 250 AND 1 - score <= 0.375 THEN 'human_leaning' ELSE 'inconclusive' END AS second_label FROM n)
    SELECT doc_id, window_no::INT AS window_no, label, second_label, label <> 'inconclusive' AND second_label <> 'inconclusive' AND label <> second_label AS disagrees FROM k"""
WINDOW_ANCHORS = f"""WITH {_WIN} SELECT w.doc_id, window_no::INT AS window_no, words::INT AS words, scheduled, start::INT AS start, {_utf16('substr(d.text, 1, start::BIGINT)')} AS from_utf16, {_utf16('substr(d.text, 1, start::BIGINT + length(w.text))')} AS to_utf16
    FROM win w JOIN (SELECT doc_id, coalesce(text, '') AS text FROM documents) d USING (doc_id)"""

_MARK = "chr(30)"
_RUN = r"[^\p{L}\p{N}_.]"


def _no_end(x: str, word: str, after: str = "", n: int = 1) -> str:
    """Takes the marks after words that end no sentence away again; overlapping ones need a second turn."""
    for _ in range(n):
        x = rf"""regexp_replace({x}, '(^|{_RUN})({word})\.(["''”’]?)' || {_MARK} || '{after}', '\1\2.\3\4', 'g')"""
    return x


_ABBREVIATED = "(?i:dr|mr|mrs|ms|prof|sr|jr|e\\.g|i\\.e|fig|eq|vs)"
_ENDED = rf"""regexp_replace(regexp_replace(coalesce(text, ''), '([.!?]["''”’]?)(\s)', '\1' || {_MARK} || '\2', 'g'), '(\n\s*\n)', '\1' || {_MARK}, 'g')"""
_ENDED = _no_end(_no_end(_ENDED, _ABBREVIATED, "()", 2), r"\p{Lu}", r"(\s*\p{Lu})", 2)
_SENTENCES = f"""pc AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split({_ENDED}, {_MARK}) AS p FROM documents)),
    po AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, regexp_replace(regexp_replace(piece, '^{SP}+', ''), '{SP}+$', '') AS sentence,
      length(regexp_replace(piece, '^{SP}+', '')) AS rest FROM pc),
    st AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, sentence, (base + length(piece) - rest)::INT AS a, (base + length(piece) - rest + length(sentence))::INT AS b FROM po WHERE sentence <> '')"""
SENTENCES = f"""WITH {_SENTENCES} SELECT doc_id AS id, 's' || n AS sentence_id, sentence, a AS "start", b AS "end" FROM st"""


def _numbers(x: str) -> str:
    return rf"list_sort(list_distinct(regexp_extract_all({x}, '\d+(?:[.,:]\d+)*')))"


def _tokenised(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


_CHECKED = rf"""{_SENTENCES},
    it AS (SELECT doc_id, n, doc_id || ':' || ((n - 1) // 2) AS id, 's' || n AS sentence_id, sentence AS quote, a, b, CASE WHEN n % 2 = 1 THEN 'redundancy' ELSE 'citation_needed' END AS issue_type, regexp_replace(sentence, '^[^\t-\r ]+[\t-\r ]+', '') AS rewrite FROM st),
    va AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sentence_id) - 1 AS item_no, max(length(rewrite)) OVER (PARTITION BY id) AS longest FROM it),
    ru AS (SELECT *, regexp_matches(quote, '\d') AS digits, regexp_matches(trim(quote), '[.!?]["''”’]*$') AS ended, regexp_matches(rewrite, '["''](?:summary|suggestions|sentence_id|issue|why|suggestion|rewrite)["'']\s*:') AS schema FROM va WHERE longest <= 2000),
    kp AS (SELECT *, CASE WHEN digits OR issue_type = 'citation_needed' THEN '' ELSE rewrite END AS kept FROM ru),
    ac AS (SELECT *, CASE WHEN schema THEN 'dropped' WHEN digits AND ended THEN 'protected' WHEN kept <> '' AND {_tokenised('kept')} = {_tokenised('quote')} THEN 'dropped' ELSE 'accepted' END AS action,
      CASE WHEN kept <> '' AND (regexp_matches(quote, '(?i)\b(?:because|was|were|is|are)\s*$') OR {_numbers(r"regexp_replace(kept, '\[[^\[\]]*\]', '', 'g')")} <> {_numbers('quote')}) THEN '' ELSE kept END AS final FROM kp),
    ck AS (SELECT *, CASE WHEN action = 'accepted' THEN CASE WHEN trim(final) <> '' AND NOT regexp_matches(trim(final), '[.!?]["''”’]*$') THEN trim(final) || '.' ELSE trim(final) END END AS told,
      CASE WHEN action = 'accepted' THEN final = '' AND (rewrite <> '' OR digits) END AS withheld FROM ac)"""
SUGGESTION_CHECKS = f"""WITH {_CHECKED} SELECT id, item_no::INT AS item_no, sentence_id, issue_type, action, told AS rewrite, withheld, quote, a AS "start", b AS "end" FROM ck"""
_GUIDE = " UNION ALL ".join(f"SELECT '{k}' AS issue_type, '{a}' AS issue, '{b}' AS why, '{c}' AS suggestion" for k, (a, b, c) in GUIDANCE.items())
ANCHORED = f"""WITH {_CHECKED}, g AS ({_GUIDE}) SELECT id, item_no::INT AS item_no, sentence_id, issue_type, told AS rewrite, withheld, quote, {_utf16('substr(text, 1, a)')} AS from_utf16, {_utf16('substr(text, 1, b)')} AS to_utf16, issue, why, suggestion
    FROM ck JOIN g USING (issue_type) JOIN documents USING (doc_id) WHERE action = 'accepted'"""
_JUDGED = rf"""{_CHECKED}, ed AS (SELECT *, told <> '' AS new FROM ck WHERE action = 'accepted'),
    jd AS (SELECT id, list_sort(list_filter([
      CASE WHEN bool_or(new AND regexp_matches(told, '[\[\]]')) THEN 'placeholder_instead_of_edit' END,
      CASE WHEN bool_or(new AND NOT regexp_matches(trim(told), '[.!?]["''”’]?$')) THEN 'incomplete_rewrite' END,
      CASE WHEN bool_or(new AND {_numbers('quote')} <> {_numbers('told')}) THEN 'changed_numeric_details' END,
      CASE WHEN NOT bool_or(new AND len(regexp_extract_all(told, '[^\t-\r ]+')) <= len(regexp_extract_all(quote, '[^\t-\r ]+')) * 0.9) THEN 'not_materially_more_concise' END,
      CASE WHEN bool_or(regexp_matches(told, '(?i)ignore previous')) THEN 'followed_embedded_instruction' END], lambda x: x IS NOT NULL)) AS failures FROM ed GROUP BY id)"""
JUDGED = f"WITH {_JUDGED} SELECT id, array_to_string(failures, ',') AS failures, len(failures) = 0 AS passed FROM jd"
JUDGED_TOTALS = f"WITH {_JUDGED} SELECT count(*) AS evaluated, count(*) FILTER (len(failures) = 0) AS passed FROM jd"
REVIEW_TOTALS = f"""WITH {_CHECKED} SELECT id, count(*) FILTER (action = 'accepted') AS suggestions, count(*) FILTER (action <> 'accepted') AS discarded, count(*) FILTER (action = 'protected') AS protected_numeric FROM ck GROUP BY id"""

ARTICLES = f"""WITH x AS (SELECT doc_id, trim(regexp_replace(text, '{SP}+', ' ', 'g')) AS body, CASE doc_id % 4 WHEN 0 THEN 'CC-BY-4.0' WHEN 1 THEN 'CC-BY-3.0' END AS named, doc_id % 4 AS kind FROM documents),
    y AS (SELECT *, CASE WHEN kind = 2 THEN 'unknown_or_ambiguous_license' WHEN kind = 3 THEN 'conflicting_license' WHEN coalesce(body, '') = '' THEN 'missing_title_or_requested_text' END AS problem FROM x)
    SELECT doc_id, CASE WHEN problem IS NULL THEN named END AS license_id, CASE WHEN problem IS NULL THEN md5(body) END AS text_md5, CASE WHEN problem IS NULL THEN 'Title ' || doc_id END AS title, problem FROM y"""

PREDICTION_INPUTS = """WITH r AS (SELECT source || '/' || (doc_id // 2) AS id, text FROM documents) SELECT id, array_to_string(list_filter([CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'repeated id' END,
    CASE WHEN trim(coalesce(text, '')) = '' THEN 'text' END, CASE WHEN length(text) > 200000 THEN 'too long' END], lambda x: x IS NOT NULL), ',') AS problems FROM r"""
RELEASES = """SELECT doc_id AS id, array_to_string(list_filter([CASE WHEN lang <> 'en' OR doc_id % 5 = 0 THEN 'identity' END, CASE WHEN doc_id % 7 = 0 THEN 'license' END,
    CASE WHEN NOT contains(coalesce(text, ''), 'the') THEN 'statement' END, CASE WHEN doc_id % 3 = 0 THEN 'catalog' END], lambda x: x IS NOT NULL), ',') AS problems FROM documents"""
PREDICTIONS = f"""WITH {_SCORED} SELECT id, array_to_string(list_filter([CASE WHEN id % 5 = 0 THEN 'preprocessing' END, CASE WHEN id % 7 = 0 THEN 'max_tokens' END, CASE WHEN length_bucket = 'long' THEN 'truncated' END,
    CASE WHEN generator IS NULL THEN 'logits' END, CASE WHEN score > 0.75 THEN 'score' END], lambda x: x IS NOT NULL), ',') AS problems FROM scored"""
SOFTMAX = f"WITH {_SCORED} SELECT id, round(1 / (1 + exp((second_score - score) * 8)), 9) AS first FROM scored"
BLOB_IDS = "SELECT doc_id, sha1('blob ' || strlen(text) || chr(0) || text) AS blob_id FROM documents"
TIMES = "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at FROM events"
EXTERNAL = f"""WITH {_EXCERPT}, r AS (SELECT d.doc_id AS id, sha256(d.text) AS document_sha256, CASE WHEN kind <> 'too_short' THEN sha256({_normal('excerpt')}) END AS text_sha256, l.doc_id IS NOT NULL AS own
      FROM documents d JOIN x USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id),
    known AS (SELECT document_sha256 AS k FROM r WHERE own AND document_sha256 IS NOT NULL UNION SELECT text_sha256 FROM r WHERE own AND text_sha256 IS NOT NULL)
    SELECT id FROM r WHERE NOT own AND (document_sha256 IN (SELECT k FROM known) OR text_sha256 IN (SELECT k FROM known))"""
FOREIGN_KEYS = "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL) OR user_id IS NULL"
PROMPT_COUNTS = "SELECT source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL"
GENERATORS = f"WITH {_SCORED} SELECT coalesce(generator, 'unknown') AS generator, count(*) AS n FROM scored GROUP BY 1"
ACQUISITION = f"""WITH i AS ({INGEST}) SELECT count(*) AS requested, count(*) FILTER (problems = '') AS accepted FROM i"""
PUBLIC = "SELECT 0.375::DOUBLE AS human_max, 0.625::DOUBLE AS ai_min, false AS product_approved"
STOPS = """WITH w AS (SELECT user_id, ts, event_id, event_type, date_diff('second', min(ts) OVER (PARTITION BY user_id), ts) AS elapsed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    y AS (SELECT *, CASE WHEN elapsed >= 864000 THEN 'time_budget' WHEN event_type = 'purchase' THEN 'promoted' WHEN n > 1 AND event_type = before THEN 'no_progress' END AS why FROM w),
    e AS (SELECT user_id, count(*) AS all_, min(n) FILTER (why IS NOT NULL) AS stop, arg_min(why, n) FILTER (why IS NOT NULL) AS why FROM y GROUP BY user_id),
    k AS (SELECT *, CASE WHEN stop IS NULL THEN all_ WHEN why = 'time_budget' THEN stop - 1 ELSE stop END AS iterations FROM e)
    SELECT k.user_id, iterations, CASE WHEN y.event_type = 'purchase' THEN 'promote' ELSE 'block' END AS decision, coalesce(k.why, 'max_iterations') AS stop_reason FROM k JOIN y ON y.user_id = k.user_id AND y.n = iterations"""
PROTOCOLS = """SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'version' END, CASE WHEN p_partkey % 3 = 0 THEN 'unknown fields' END, CASE WHEN p_partkey % 5 = 0 THEN 'checks' END,
    CASE WHEN p_partkey % 7 = 0 THEN 'scripts' END, CASE WHEN p_partkey % 11 = 0 THEN 'timeouts' END, CASE WHEN p_partkey % 13 = 0 THEN 'none required' END, CASE WHEN p_partkey % 17 = 0 THEN 'unknown checks' END], lambda x: x IS NOT NULL), ',') AS problems FROM part"""
SHOWN = f"""WITH {_SCORED}, v AS (SELECT id, score FROM scored UNION ALL SELECT -id - 1, round(score, 3) FROM scored), t AS (SELECT id, score::VARCHAR AS s, score FROM v),
    d AS (SELECT *, rtrim(ltrim(replace(s, '.', ''), '0'), '0') AS digits FROM t)
    SELECT id, CASE WHEN score >= 1 THEN '1.000000000' WHEN score = 0 THEN '0.000000000' WHEN length(digits) > 10 THEN s ELSE regexp_extract(s, '^0\\.0*') || rpad(digits, 10, '0') END AS shown FROM d"""
DIGEST_WHOLE = """WITH a AS (SELECT doc_id AS k, doc_id || ':' || quality || ':' || toxic AS line FROM labels), b AS (SELECT k // 1000 AS k, sha256(string_agg(line, ',' ORDER BY k, line)) AS line FROM a GROUP BY 1),
    c AS (SELECT k // 1000 AS k, sha256(string_agg(line, ',' ORDER BY k, line)) AS line FROM b GROUP BY 1), d AS (SELECT k // 1000 AS k, sha256(string_agg(line, ',' ORDER BY k, line)) AS line FROM c GROUP BY 1)
    SELECT sha256(string_agg(line, ',' ORDER BY k, line)) AS sha256 FROM d"""
LEAKS_FULL = f"""WITH {_EXCERPT}, {_SPLITS}, r AS (SELECT split, d.doc_id::VARCHAR AS id, split_unit, d.source || '/' || (d.doc_id // 40) AS source_group, d.lang AS prompt, CASE WHEN kind <> 'too_short' THEN sha256({_normal('excerpt')}) END AS text_sha256, sha256(d.text) AS document_sha256
      FROM documents d JOIN sp USING (doc_id) JOIN x USING (doc_id)),
    v AS ({" UNION ALL ".join(f"SELECT split, '{k}' AS field, {k} AS value FROM r" for k in ("id", "split_unit", "source_group", "prompt", "text_sha256", "document_sha256"))})
    SELECT field, value, count(DISTINCT split) AS n_splits FROM v WHERE value IS NOT NULL GROUP BY field, value HAVING count(DISTINCT split) > 1"""
FIRST_FAMILY = f"""WITH {_EXCERPT}, r AS (SELECT source, min(doc_id) FILTER (quality = 1) AS human_id, min(doc_id) FILTER (quality = 0) AS ai_id FROM documents JOIN labels USING (doc_id) GROUP BY source),
    f AS (SELECT * FROM r WHERE human_id IS NOT NULL AND ai_id IS NOT NULL ORDER BY source LIMIT 1)
    SELECT source AS source_group, human_id, ai_id, md5(a.excerpt || chr(10) || chr(10) || b.excerpt) AS text_md5 FROM f JOIN x a ON a.doc_id = human_id JOIN x b ON b.doc_id = ai_id"""
VERSIONS = f"""WITH {_SCORED}, p AS (SELECT id, score, {_decide('score')} AS label, second_score, {_decide('second_score')} AS second_label, CASE WHEN id % 3 = 0 THEN 'r2' ELSE 'r1' END AS revision FROM scored)
    SELECT id, label AS label_before, second_label AS label_after, revision = 'r1' AS comparable, CASE WHEN revision <> 'r1' THEN 'Not comparable' WHEN label = second_label THEN 'Same signal' ELSE 'Signal changed' END AS signal FROM p"""
