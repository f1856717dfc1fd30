"""DuckDB SQL with the results of those queries that SQL can express.

There is none for the classifier, the language model, the graph index, the token merges and the checksummed
secrets, nor for fingerprints, which rest on Spark's xxhash64: tests hold these against brute force.
"""

from __future__ import annotations

from . import licenses, mixing

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
WORDS = r"'[^\x20\x09-\x0D]+'"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def op2() -> str:
    """The base columns rest on the contract's phrases alone, as lists of words; only labels and score read the rules."""
    rules = ",\n  ".join(f"({i}, {quoted(r.keyword)}, {quoted(r.pattern)}, {r.priority}, {r.confidence}::DOUBLE, {r.base}, {quoted(r.label)})" for i, r in enumerate(licenses.rules()))
    anchors = " OR ".join(f"contains(s, {quoted(a)})" for a in licenses.ANCHORS)
    words = lambda x: f"((length({x}) - length(replace({x}, ' ', ''))) // 2)"
    return f"""
WITH rules(ord, keyword, pattern, priority, confidence, base, label) AS (VALUES
  {rules}),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, ' ' || trim(regexp_replace({LOWERED}, {quoted(licenses.SEPARATORS)}, '  ', 'g'), ' ') || ' ' AS s,
  regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases(p, label) AS (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')),
plain AS (SELECT r, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS start FROM docs, phrases),
base AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM plain GROUP BY r),
hit AS (SELECT r, s, rules.*, string_split_regex(s, pattern) AS gaps, regexp_extract_all(s, pattern) AS found
  FROM docs JOIN rules ON contains(s, keyword) WHERE {anchors}),
places AS (SELECT r, ord, priority, confidence, base, label, unnest(list_transform(range(1, len(found) + 1), lambda i: struct_pack(
    at := CAST(list_sum(list_transform(gaps[1:i], lambda g: {words("g")})) + coalesce(list_sum(list_transform(found[1:i-1], lambda f: {words("f")})), 0) AS BIGINT),
    long := {words("found[i]")}))) AS p FROM hit WHERE len(found) > 0),
det AS (SELECT r, ord, priority, confidence, base, label, p.at AS start, p.at + p.long AS stop FROM places),
kept AS (SELECT * FROM det d WHERE base OR NOT EXISTS (SELECT 1 FROM det e WHERE e.r = d.r AND e.start <= d.start AND e.stop >= d.stop AND (e.priority > d.priority
  OR (e.priority = d.priority AND (e.stop - e.start > d.stop - d.start OR (e.stop - e.start = d.stop - d.start AND e.ord < d.ord)))))),
per AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(confidence) AS score FROM kept GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN per USING (r) LEFT JOIN base USING (r)"""


#: What the chat template must escape, and the marks of a turn. Fixed values, said again here so that the SQL rests on no code.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
MARKS = len("<|im_start|>" + "\n" + "<|im_end|>" + "\n")


def op3() -> str:
    def escaped(x: str) -> str:
        x = f"replace({x}, '\\', '\\\\')"
        for c in CONTROLS:
            x = f"replace({x}, {quoted(c)}, {quoted(c[0] + chr(92) + c[1:])})"
        return x

    said = quoted("</s>[INST] ok [/INST]")
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {said} UNION ALL SELECT -1, 1, 'assistant', {said}),
per AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum({MARKS} + length(replace({escaped("role")}, chr(10), '\\' || chr(10))) + length({escaped("text")})) AS formatted
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM per"""


def op8(k: int = 3, num: int = 90, den: int = 100) -> str:
    shingle = f"list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i+{k - 1}], ' '))"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, {WORDS}) AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE {shingle} END) AS s FROM d),
size AS MATERIALIZED (SELECT r, count(*) AS n FROM sh GROUP BY r),
both_ AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM both_ JOIN size x ON x.r = a JOIN size y ON y.r = b WHERE {den} * common >= {num} * (x.n + y.n - common)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles,
  least(d.doc_id, coalesce((SELECT min(o.doc_id) FROM reach JOIN d o ON o.r = reach.b WHERE reach.a = d.r), d.doc_id)) AS component_id,
  (SELECT count(*) FROM edge WHERE edge.a = d.r) AS n_links
FROM d LEFT JOIN size USING (r)"""


def op10(share: float = 1.5, cap: int = 2) -> str:
    weights = f"[{', '.join(f'{w}.0' for w in mixing.WEIGHTS)}]"
    return f"""
WITH sized AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
num AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM src),
w AS (SELECT *, {weights}[(src - 1) % {len(mixing.WEIGHTS)} + 1]::DOUBLE AS weight, (source_size * {cap})::DOUBLE AS cap FROM num),
lev AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER () * {share}::DOUBLE - (sum(cap) OVER u - cap)) / (sum(weight) OVER () - (sum(weight) OVER u - weight)) AS level
  FROM w WINDOW u AS (ORDER BY cap / weight, src ROWS UNBOUNDED PRECEDING)),
plan AS MATERIALIZED (SELECT source, source_size, src, least(cap, (SELECT arg_min(level, (ratio, src)) FROM lev WHERE level <= ratio) * weight) AS target FROM lev),
b1 AS (SELECT *, greatest(1, least(65536, sum(source_size) OVER () // {mixing.BLOCKS}, source_size // {mixing.LEAST_BLOCKS})) AS block FROM plan WHERE source_size > 0),
b2 AS (SELECT *, CAST(ceil(source_size / block) AS BIGINT) AS blocks FROM b1),
b3 AS (SELECT *, target * blocks / source_size AS part FROM b2),
run AS (SELECT *, sum(part) OVER (ORDER BY src ROWS UNBOUNDED PRECEDING) AS sofar FROM b3),
b4 AS (SELECT *, max(sofar) OVER () AS total, sofar / max(sofar) OVER () AS hi FROM run),
cut AS MATERIALIZED (SELECT *, coalesce(lag(hi) OVER (ORDER BY src), 0.0) AS lo FROM b4),
slot AS (SELECT i AS slot, i * {mixing.GOLDEN}::DOUBLE - floor(i * {mixing.GOLDEN}::DOUBLE) AS u FROM range((SELECT CAST(ceil(max(total)) AS BIGINT) FROM cut)) t(i)),
rank_ AS (SELECT src, blocks, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS r FROM slot JOIN cut ON u >= lo AND u < hi),
times AS MATERIALIZED (SELECT src, r % blocks AS block, count(*) AS times FROM rank_ WHERE r < {cap} * blocks GROUP BY 1, 2),
laid AS MATERIALIZED (SELECT doc_id, size, cut.src, cut.source_size, blocks, sum(size) OVER (PARTITION BY cut.src ORDER BY coalesce(md5(CAST(doc_id AS VARCHAR)), ''), doc_id, size ROWS UNBOUNDED PRECEDING) AS stop
  FROM sized JOIN cut ON sized.source IS NOT DISTINCT FROM cut.source WHERE size > 0),
piece AS (SELECT *, unnest(range(CAST((stop - size) * blocks // source_size AS BIGINT), CAST((stop - 1) * blocks // source_size AS BIGINT) + 1)) AS block FROM laid),
word AS (SELECT piece.*, least(stop, ((block + 1) * source_size + blocks - 1) // blocks) - greatest(stop - size, (block * source_size + blocks - 1) // blocks) AS words FROM piece),
taken AS (SELECT src, stop, sum(words * coalesce(times, 0)) AS taken FROM word LEFT JOIN times USING (src, block) GROUP BY 1, 2)
SELECT doc_id, size, laid.source_size, target, CAST(taken AS BIGINT) AS taken FROM laid JOIN taken USING (src, stop) JOIN plan USING (src)
UNION ALL
SELECT doc_id, size, source_size, target, 0 FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source WHERE size = 0"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": op2(), "op3_chat_format": op3(), "op8_ngram_jaccard": op8(), "op10_mixing": op10()}
