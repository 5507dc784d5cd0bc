"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from eraflow.llm import decontam, langid, mixing, neardup, pieces, quality, repair, templates, tokens, toxicity, trie, urlfilter, warc
from eraflow.llm.common import table, work_dir
from eraflow.llm.registry import register

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

MIX_SEED, MIX_ALPHA, MIX_EPOCHS = 20, 0.7, 1.0

# The rules of the address filter.
RULES = (
    urlfilter.Rule("net", "/", "block"),
    urlfilter.Rule("example.net", "/en/", "allow"),
    urlfilter.Rule("example.com", "/de/", "block"),
    urlfilter.Rule("org", "/fr/", "allow"),
)


def crc_of(doc_id: str):
    """crc32 of an id written as text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


OP1_SQL = """
WITH s AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(encode(coalesce(html, ''))) AS mark FROM pages),
b AS (SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY mark) AS top,
             array_to_string([lpad(bin(('0x' || substr(mark, 10 * j + 1, 10))::UBIGINT), 40, '0') FOR j IN range(4)], '') AS bits FROM s)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce([0] || [substr(bits, 5 * j + i + 1, 1)::INT FOR i IN range(5)], lambda a, x: 2 * a + x), 1)
                        FOR j IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM b
"""


@register("op1_capture_index", OP1_SQL)
def op1(spark, sf_dir):
    folder = work_dir(spark, "op1")
    captures = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    shards = warc.build_index(captures, folder)
    asked = table(spark, sf_dir, "pages").select(warc.index_key(F.col("url")).alias("key"), "page_id")
    records = warc.read_records(warc.lookup(asked, shards))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op2_byte_network")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc_of("doc_id") % 3 == 1
    model = langid.fit(langid.training_rows(docs.where(~held_out)))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


TOKENS = r"[CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END FOR t IN regexp_split_to_array(line, '[\x20\x09-\x0D]+') IF t <> '']"

OP3_SQL = rf"""
WITH d AS (SELECT *, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM d),
t AS (SELECT doc_id, line_no, {TOKENS} AS w FROM l),
k AS (SELECT doc_id, line_no, w, array_to_string(w, ' ') AS full_line, len(w) || ' ' || array_to_string(w[1:{templates.DEPTH}], ' ') AS leaf
      FROM t WHERE len(w) >= {templates.MIN_TOKENS}),
ex AS (SELECT full_line, min((doc_id, line_no)) AS first FROM k GROUP BY full_line HAVING count(DISTINCT doc_id) >= {templates.MIN_DOCS}),
single AS (SELECT * FROM k WHERE full_line NOT IN (SELECT full_line FROM ex)),
m AS (SELECT * FROM single WHERE leaf IN (SELECT leaf FROM single GROUP BY leaf HAVING count(DISTINCT doc_id) >= {templates.MIN_DOCS})),
sz AS (SELECT leaf, count(*) AS size FROM m GROUP BY leaf),
tok AS (SELECT leaf, place, token, count(*) AS n FROM (SELECT leaf, unnest(range(len(w))) AS place, unnest(w) AS token FROM m) GROUP BY ALL),
con AS (SELECT leaf, place, token FROM tok JOIN sz USING (leaf) WHERE n * 2 > size),
agree AS (SELECT doc_id, line_no, m.leaf, len(w) AS n, count(con.token) AS a FROM m LEFT JOIN con ON con.leaf = m.leaf AND m.w[con.place + 1] = con.token
          GROUP BY doc_id, line_no, m.leaf, len(w)),
near AS (SELECT * FROM agree WHERE a * 10 >= n * {templates.SIMILAR}),
ge AS (SELECT leaf, min((doc_id, line_no)) AS first FROM near GROUP BY leaf HAVING count(DISTINCT doc_id) >= {templates.MIN_DOCS}),
bad AS (SELECT doc_id, line_no FROM k JOIN ex USING (full_line) WHERE (doc_id, line_no) <> first
        UNION SELECT doc_id, line_no FROM near JOIN ge USING (leaf) WHERE (doc_id, line_no) <> first),
byd AS (SELECT doc_id, list(line_no) AS drops FROM bad GROUP BY doc_id)
SELECT doc_id, CASE WHEN drops IS NULL THEN text ELSE array_to_string([ls[i + 1] FOR i IN range(len(ls)) IF NOT list_contains(drops, i)], chr(10)) END AS text,
       coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(drops), 0)::BIGINT AS n_dropped
FROM d LEFT JOIN byd USING (doc_id)
"""


@register("op3_template_tree", OP3_SQL)
def op3(spark, sf_dir):
    found = templates.drop_recurring(table(spark, sf_dir, "documents"), work_dir(spark, "op3"))
    return found.select("doc_id", "text", "n_lines", "n_dropped")


@register("op4_noisy_or")
def op4(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_of("doc_id") % 5 == 0
    model = toxicity.fit(toxicity.training_rows(docs, labels.where(~held_out)))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    predicted = (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    return found.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), predicted)


@register("op6_divergence_rules")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = quality.assess(docs.select("doc_id", "text"), quality.references(docs))
    return found.select("doc_id", *quality.BASE, "base_failed", "char_distance", "word_distance", "kept")


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE
         list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)]) END AS sh FROM d),
e AS (SELECT rid, unnest(sh) AS x FROM s),
links AS (
  SELECT p.a, p.b FROM (SELECT l.rid AS a, r.rid AS b, count(*) AS c FROM e l JOIN e r ON l.x = r.x AND l.rid <> r.rid GROUP BY ALL) p
  JOIN s sa ON sa.rid = p.a JOIN s sb ON sb.rid = p.b WHERE 100 * c >= 75 * (len(sa.sh) + len(sb.sh) - c)),
reach(a, b) AS (SELECT rid, rid FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(t.doc_id) AS component_id, s.doc_id = min(t.doc_id) AS kept
FROM s JOIN reach ON reach.a = s.rid JOIN s t ON t.rid = reach.b GROUP BY s.rid, s.doc_id, s.sh
"""


@register("op5_tensored_minhash", OP5_SQL)
def op5(spark, sf_dir):
    found = neardup.cluster(table(spark, sf_dir, "documents"), work_dir(spark, "op5"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


DECONTAMINATION_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({LOWERED},
         '{DECONTAMINATION_WORDS}'), []) AS w, row_number() OVER () AS rid FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({LOWERED},
         '{DECONTAMINATION_WORDS}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
         unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ') FOR i IN range(1, greatest(len(w) - 9, 1) + 1)]) AS win
  FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS s, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS win
  FROM d, lens WHERE len(w) >= n),
hit AS (SELECT DISTINCT rid, s, n, win FROM dw WHERE win IN (SELECT win FROM bw)),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
hi AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit JOIN bw USING (win)) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""


@register("op7_winnowing_decontamination", OP7_SQL)
def op7(spark, sf_dir):
    found = decontam.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), work_dir(spark, "op7")
    )
    digest = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
u AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


@register("op8_bloom_cascade", OP8_SQL)
def op8(spark, sf_dir):
    judged = urlfilter.judge(table(spark, sf_dir, "pages"), RULES, work_dir(spark, "op8"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def mix_sql(docs: str, columns: str, terms: int = mixing.TERMS, alpha: float = MIX_ALPHA) -> str:
    """CTEs ``copies`` (``columns``, copy, shuffle_key) of the mix of table ``docs``."""
    unit = f"(('0x' || substr(md5('{MIX_SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || j), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0)"
    return f"""
mix_sizes AS (SELECT source, sum(coalesce(length(text), 0))::BIGINT AS n FROM {docs} GROUP BY source),
mix_rates AS (
  SELECT source, CASE WHEN n > 0 THEN {MIX_EPOCHS}::DOUBLE * (SELECT sum(n) FROM mix_sizes)
         * (pow(n::DOUBLE, {alpha}) / (SELECT sum(pow(n::DOUBLE, {alpha})) FROM mix_sizes WHERE n > 0)) / n ELSE 1.0 END AS rate
  FROM mix_sizes),
mix_means AS (SELECT source, greatest(ceil(rate / {mixing.MAX_MEAN}), 1)::BIGINT AS draws, rate / greatest(ceil(rate / {mixing.MAX_MEAN}), 1) AS m FROM mix_rates),
mix_terms AS (
  SELECT source, draws, k, exp(-m) * product(CASE WHEN k = 0 THEN 1.0 ELSE m / k END) OVER (PARTITION BY source ORDER BY k) AS term
  FROM mix_means, range({terms}) t(k)),
mix_cdf AS (SELECT source, draws, list(c ORDER BY c) AS cdf FROM
  (SELECT source, draws, sum(term) OVER (PARTITION BY source ORDER BY k) AS c FROM mix_terms) GROUP BY source, draws),
mix_counts AS (
  SELECT d.*, list_sum([len(list_filter(cdf, lambda c: c <= {unit})) FOR j IN range(1, draws + 1)]) AS n_copies
  FROM {docs} d JOIN mix_cdf c ON d.source IS NOT DISTINCT FROM c.source),
copies AS (
  SELECT {columns}, copy::INTEGER AS copy, md5('{MIX_SEED}-order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy) AS shuffle_key
  FROM (SELECT *, unnest(range(1, n_copies::BIGINT + 1)) AS copy FROM mix_counts WHERE n_copies > 0))"""


OP9_SQL = f"WITH {mix_sql('documents', 'doc_id, text, lang, source, n_chars')} SELECT * FROM copies"


@register("op9_poisson_mixing", OP9_SQL)
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.replicate(docs, mixing.temperature_rates(docs, MIX_ALPHA, MIX_EPOCHS), MIX_SEED)


@register("op10_arrow_sequences")
def op10(spark, sf_dir):
    index = tokens.write_sequences(table(spark, sf_dir, "documents"), work_dir(spark, "op10"), VOCABULARY)
    return tokens.read_back(index)


@register("op11_piece_agenda")
def op11(spark, sf_dir):
    found = pieces.digest_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


CRC_SQL = """list_reduce([4294967295::BIGINT] || flatten([[ord(z)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR z IN string_split({0}, '')]),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)"""


def _added(key: str, cost: str, letter: str) -> str:
    """SQL of a path (8 digits of cost, then the audit) with one more edit."""
    return f"(lpad((substr({key}, 1, 8)::INT + {cost})::VARCHAR, 8, '0') || substr({key}, 9) || '{letter}')"


def _inserted(paths: str) -> str:
    """SQL of four paths, by state, with inserted turns behind."""
    to_user = ", ".join(_added(f"k[{q}]", "3", "I") for q in (1, 2, 4))
    first = f"list_transform([{paths}], lambda k: [k[1], k[2], least(k[3], {to_user}), k[4]])[1]"
    then = f"list_transform([{first}], lambda k: [k[1], k[2], k[3], least(k[4], {_added('k[3]', '3', 'I')})])[1]"
    return f"list_transform([{then}], lambda k: [k[1], k[2], least(k[3], {_added('k[4]', '3', 'I')}), k[4]])[1]"


def _edited() -> str:
    """SQL of four paths after turn ``x`` (i: initial, p: cost if it stays, m: must go)."""
    never = "'99999999'"
    gone = [_added(f"k[{q}]", "4", "D") for q in (1, 2, 3, 4)]
    stays = lambda cost, letter, *states: "least(" + ", ".join(_added(f"k[{q}]", cost, letter) for q in states) + ")"
    system = f"CASE WHEN NOT x.m AND x.i = 's' THEN {stays('x.p', 'K', 1)} ELSE {never} END"
    user = [f"CASE WHEN NOT x.m THEN {stays('3 + x.p', 'R', 1, 2, 4)} ELSE {never} END",
            f"CASE WHEN NOT x.m AND x.i = 'u' THEN {stays('x.p', 'K', 1, 2, 4)} ELSE {never} END"]
    reply = [f"CASE WHEN NOT x.m THEN {stays('3 + x.p', 'R', 3)} ELSE {never} END",
             f"CASE WHEN NOT x.m AND x.i = 'a' THEN {stays('x.p', 'K', 3)} ELSE {never} END"]
    after = f"[{gone[0]}, least({gone[1]}, {system}), least({gone[2]}, {', '.join(user)}), least({gone[3]}, {', '.join(reply)})]"
    return _inserted(after)


OP12_SQL = rf"""
WITH h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor({CRC_SQL.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")}, 4294967295) % 20 AS kind FROM conversations),
r AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM r),
f AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
         NOT regexp_matches(text, '[.!?][ 	-
]*$') AS short, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM o),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE short AND NOT again AND NOT blank) AS truncated,
         count(*) FILTER (WHERE n > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal,
         list({{'i': i, 'p': CASE WHEN short THEN 3 ELSE 0 END, 'm': blank OR again, 'role': role, 'text': text}} ORDER BY n) AS turns FROM f GROUP BY conv_id),
s AS (SELECT conv_id, {{'k': {_inserted("['00000000', '99000000', '99000000', '99000000']")}, 't': NULL}} AS zero, turns FROM c),
w AS (
  SELECT conv_id, list_reduce([{{'k': zero.k, 'x': {{'i': '', 'p': 0, 'm': true, 'role': '', 'text': ''}}}}] || [{{'k': NULL::VARCHAR[], 'x': t}} FOR t IN turns],
         lambda a, b: list_transform([{{'k': a.k, 'x': b.x}}], lambda y: {{'k': list_transform([y], lambda z: list_transform([z.k], lambda k: list_transform([z.x], lambda x: {_edited()})[1])[1])[1], 'x': y.x}})[1]).k AS paths
  FROM s),
b AS (SELECT conv_id, least(paths[1], paths[4]) AS path FROM w),
a AS (SELECT c.*, substr(path, 1, 8)::BIGINT AS cost, substr(path, 9) AS audit FROM c JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id),
l AS (
  SELECT *, [{{'e': audit[j], 't': turns[length(replace(audit[1:j], 'I', ''))], 'nth': length(replace(audit[1:j], 'D', ''))}} FOR j IN range(1, length(audit) + 1) IF audit[j] <> 'D'] AS kept FROM a),
g AS (SELECT *, CASE WHEN kept[1].e = 'K' AND kept[1].t.i = 's' THEN 1 ELSE 0 END AS system FROM l)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string([CASE WHEN e.e = 'K' THEN e.t.role WHEN (e.nth - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
              CASE WHEN e.e = 'I' THEN '' ELSE e.t.text END FOR e IN kept], chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) every LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM every.conv_id
"""


@register("op12_viterbi_repair", OP12_SQL)
def op12(spark, sf_dir):
    conversations, folder = table(spark, sf_dir, "conversations"), work_dir(spark, "op12")
    whole, cut = repair.repair(repair.damaged(conversations), folder)
    return repair.summaries(conversations, whole, cut, folder)


OP13_SQL = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {trie.FAMILY} AS base, xor({CRC_SQL.format("conv_id::VARCHAR")}, 4294967295) % {trie.HEADS} AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS own, n, role, text FROM c JOIN t ON t.conv_id = base WHERE n <= h
  UNION ALL SELECT c.conv_id, 1, n, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE n > h),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, n) AS d FROM r),
m AS (
  SELECT conv_id, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         string_agg(sha256(role || chr(0) || text), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d) AS node FROM p
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT conv_id, max(d) AS d FROM m GROUP BY conv_id),
n AS (
  SELECT node, m.d AS depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (WHERE e.d = m.d), '')) AS ends_sha256
  FROM m JOIN e USING (conv_id) GROUP BY node, m.d),
k AS (SELECT substr(node, 1, 64 * depth - 64) AS parent, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
u AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.parent = n.node),
s AS (SELECT a.node, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves
      FROM u a JOIN u b ON b.depth >= a.depth AND starts_with(b.node, a.node) GROUP BY a.node)
SELECT u.conv_id, u.depth, v.conv_id AS parent_conv_id, u.n_convs, u.n_children, n_leaves, saved_tokens, u.ends_sha256
FROM u JOIN s USING (node) LEFT JOIN n v ON u.depth > 0 AND v.node = substr(u.node, 1, 64 * u.depth - 64)
"""


@register("op13_prefix_trie", OP13_SQL)
def op13(spark, sf_dir):
    return trie.nodes(table(spark, sf_dir, "conversations"), work_dir(spark, "op13"))
