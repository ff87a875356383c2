"""The registered queries of this package and, where SQL can express them, their twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import divergence, langid, lines, minhash, packing, permutation, pieces, quality, search, simhash, threads, token_files, warc
from matchloom.llm.common import read
from matchloom.session import cut_lineage, ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    if fn.__name__ in QUERIES:
        raise ValueError(f"{fn.__name__} is registered already")
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_adaptive_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base rules and sketch-based verdict of every document."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    judged = quality.adaptive_rules(docs, carry=False)
    return judged.select(
        "doc_id",
        *[F.col("quality")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
    )


@query
def op2_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read(spark, folder, "documents"))


@query
def op9_binary_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of power-of-two length of every document, each a sequence without padding."""
    import public_tokenizers

    pieces = packing.decompose(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), literal=False)
    return packing.with_digest(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, learned from three quarters of the labelled ones."""
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.train(docs.where(~held_out & F.col("doc_id").isNotNull()))
    return langid.identify(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.accepted").alias("accepted"),
    )


@query
def op3_fuzzy_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the lines that nearly repeat an earlier one, and what was dropped."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, shingle=lines.FINE).select(
        "doc_id",
        F.col("dropped.n_lines").alias("n_lines"),
        F.size("dropped.lines").cast("long").alias("n_dropped"),
        F.col("dropped.lines").alias("dropped_lines"),
        F.col("dropped.kept_ids").alias("kept_doc_ids"),
        "text",
    )


@query
def op8_elias_fano_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token files of all documents, read back: place, length and checksum of each."""
    import public_tokenizers

    place = f"{ensure_checkpoint_dir(spark)}/matchloom/tokens-{uuid.uuid4().hex}"
    manifest = token_files.write_tokens(read(spark, folder, "documents"), place, public_tokenizers.path("byte_bpe_50k.json"), literal=False)
    return token_files.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op6_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector, by inner product."""
    index = permutation.build_index(read(spark, folder, "embeddings"))
    return permutation.search(index, index.where(F.col("id") % 20 == 0))


@query
def op10_quotation_threads(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that quote earlier ones, without quotations again, in reply order, as chat markup."""
    messages = threads.quoting(read(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))
    ordered = threads.reply_order(cut_lineage(messages))
    return threads.as_chat(ordered).select("conv_id", "turn", "role", "text", "chat", "reply.*")


ORACLES["op10_quotation_threads"] = r"""
WITH RECURSIVE said AS (SELECT conv_id AS c, turn::BIGINT AS t, min(text) AS said FROM conversations GROUP BY ALL),
first AS (SELECT *, CASE WHEN turn > 0 THEN turn - 1 - (conv_id + turn) % least(turn, 3) END AS up1 FROM conversations),
second AS (SELECT *, CASE WHEN up1 > 0 THEN up1 - 1 - (conv_id + up1) % least(up1, 3) END AS up2 FROM first),
third AS (SELECT *, CASE WHEN up2 > 0 THEN up2 - 1 - (conv_id + up2) % least(up2, 3) END AS up3 FROM second),
quoting AS (
    SELECT m.conv_id, m.turn, m.role, CASE WHEN m.text IS NOT NULL THEN array_to_string(list_concat(
        CASE WHEN m.turn % 4 = 0 THEN list_transform(list_filter(string_split(z.said, chr(10)), lambda x, i: (i + m.turn) % 3 <> 0), lambda x: '>>> ' || x) END,
        CASE WHEN m.turn % 2 = 0 THEN list_transform(list_filter(string_split(y.said, chr(10)), lambda x, i: (i + m.turn) % 3 <> 0), lambda x: '>> ' || x) END,
        list_transform(list_filter(string_split(x.said, chr(10)), lambda x, i: (i + m.turn) % 3 <> 0), lambda x: '> ' || x), [m.text]), chr(10)) END AS text
    FROM third m LEFT JOIN said x ON x.c = m.conv_id AND x.t = up1 LEFT JOIN said y ON y.c = m.conv_id AND y.t = up2
        LEFT JOIN said z ON z.c = m.conv_id AND z.t = up3
), cut AS (
    SELECT conv_id, turn, role, text, row_number() OVER () AS uid, string_split(text, chr(10)) AS parts FROM quoting
), lines AS (
    SELECT uid, conv_id, turn, i, parts[i] AS line, regexp_extract(parts[i], '^((?:[ \t]*>)+)', 1) AS signs
    FROM cut, unnest(range(1, len(parts) + 1)) AS r(i)
), parsed AS (
    SELECT *, length(signs) - length(replace(signs, '>', '')) AS level,
        lower(trim(regexp_replace(substr(line, length(signs) + 1), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS said
    FROM lines
), own AS (
    SELECT uid, count(*) FILTER (level > 0) AS n_quoted,
        trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), ''), chr(10)) AS rest
    FROM parsed GROUP BY uid
), origins AS (
    SELECT conv_id, said, min(turn) AS origin FROM parsed WHERE level = 0 AND said <> '' GROUP BY ALL
), votes AS (
    SELECT conv_id, turn, level, origin, count(*) AS n FROM parsed JOIN origins USING (conv_id, said)
    WHERE level > 0 AND origin < turn GROUP BY ALL
), parents AS (
    SELECT conv_id, turn, sum(n)::BIGINT AS n_linked, arg_max(origin, (-level, n, origin)) AS parent FROM votes GROUP BY ALL
), chains AS (
    SELECT conv_id, turn, turn AS up, 0::BIGINT AS depth FROM parents
    UNION ALL
    SELECT c.conv_id, c.turn, p.parent, c.depth + 1 FROM chains c JOIN parents p ON p.conv_id = c.conv_id AND p.turn = c.up
), roots AS (
    SELECT conv_id, turn, arg_max(up, depth) AS thread, max(depth) AS depth FROM chains GROUP BY ALL
), placed AS (
    SELECT c.conv_id, c.turn, c.role, c.uid, CASE WHEN o.n_quoted > 0 THEN o.rest ELSE c.text END AS text,
        p.parent AS reply_to, coalesce(r.thread, c.turn) AS thread, coalesce(r.depth, 0) AS depth,
        coalesce(o.n_quoted, 0) AS n_quoted, coalesce(p.n_linked, 0) AS n_linked
    FROM cut c LEFT JOIN own o USING (uid) LEFT JOIN parents p ON p.conv_id = c.conv_id AND p.turn = c.turn
    LEFT JOIN roots r ON r.conv_id = c.conv_id AND r.turn = c.turn
)
SELECT conv_id, turn, role, text,
    '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS chat,
    reply_to, thread, depth,
    CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL
        THEN row_number() OVER (PARTITION BY conv_id ORDER BY thread, depth, turn, uid) END AS position,
    n_quoted, n_linked
FROM placed
"""


#: Seconds after which a page is asked for again.
ASKED_AGAIN = 500


@query
def op5_revisit_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """The revisits of a crawl of all pages, resolved to the responses they stand for."""
    texts = warc.as_records(read(spark, folder, "pages"), ASKED_AGAIN)
    records = warc.parse_records(texts, "record").select("warc.*")
    number = lambda c: F.regexp_extract(c, r"-(-?\d+)$", 1).cast("long")
    return warc.resolve_revisits(records).select(
        number("id").alias("page_id"),
        "canonical",
        F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"),
        "outcome",
        F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("headers"),
        F.md5(F.col("payload").cast("binary")).alias("payload_md5"),
    )


ORACLES["op5_revisit_resolution"] = rf"""
WITH cut AS (
    SELECT page_id, coalesce(html, '') AS html, regexp_replace(trim(url), '#.*$', '') AS u,
        '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*' AS site FROM pages WHERE url IS NOT NULL AND page_id IS NOT NULL
), parts AS (
    SELECT page_id, html, lower(regexp_replace(regexp_extract(u, site), '^[^:]*://', '')) AS host, regexp_replace(u, site, '') AS rest FROM cut
), urls AS (
    SELECT page_id, html,
        regexp_replace(regexp_replace(host, '^(?:[^@]*@)?(?:www[0-9]*\.|m\.)?', ''), ':(?:80|443)$', '')
            || regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', '') AS place,
        list_sort(list_filter(string_split(regexp_replace(rest, '^[^?]*\??', ''), '&'),
            lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[a-z]+|gclid|fbclid)='))) AS query
    FROM parts
), pages_at AS (
    SELECT page_id, md5(html) AS tag, strlen(html) AS size,
        place || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS canonical
    FROM urls
), asked AS (
    SELECT r.page_id, r.canonical, r.tag, s.page_id AS refers_to, s.tag AS stored, s.size
    FROM (SELECT *, page_id + {ASKED_AGAIN} AS at FROM pages_at) r ASOF LEFT JOIN pages_at s ON r.canonical = s.canonical AND r.at > s.page_id
), dated AS (
    SELECT *, strftime(to_timestamp(1700000000 + page_id + {ASKED_AGAIN}) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS day FROM asked
)
SELECT page_id, canonical, refers_to, CASE WHEN tag = stored THEN 'resolved' ELSE 'mismatch' END AS outcome,
    'cache-control=max-age=60;content-length=' || CASE WHEN tag = stored THEN size || ';content-type=text/html' ELSE '0' END
        || ';date=' || day || ';etag=W/"' || tag || '"' AS headers,
    CASE WHEN tag = stored THEN stored END AS payload_md5
FROM dated
"""


@query
def op7_sentencepiece_lattice(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded on the lattice: number and checksum of its ids, and whether they decode to the text."""
    import public_tokenizers

    table = pieces.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.MARK), F.lit(" "))
    docs = read(spark, folder, "documents").select("doc_id", "text", F.xxhash64(text).alias("text_hash"))
    return pieces.decode(pieces.encode(docs, table), "ids", table).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"),
        (F.xxhash64("decoded") == F.col("text_hash")).alias("round_trip"),
    )


def _quality_sql() -> str:
    spread, names = quality.LEAST_SPREAD, list(quality.LEAST_SPREAD)
    space = r"[\x20\x09-\x0D]"
    levels = {
        "0": "'0|' || coalesce('l' || lang, '-') || '|' || coalesce('s' || source, '-')",
        "1": "'1|' || coalesce('l' || lang, '-')",
        "2": "'2'",
    }
    rows = " UNION ALL ".join(
        f"SELECT {key} AS k, '{name}' AS rate, {name} AS v FROM rated WHERE NOT base_failed" for key in levels.values() for name in names
    )
    floors = " ".join(f"WHEN '{name}' THEN {value}" for name, value in spread.items())
    over = " OR ".join(f"(f.rate = '{name}' AND r.{name} > f.high)" for name in names)
    under = " OR ".join(f"(f.rate = '{name}' AND r.{name} < f.low)" for name in quality.TWO_SIDED)
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
cut AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
grams AS (SELECT uid, i, words[i:i + 4] AS g FROM cut, unnest(range(1, len(words) - 3)) AS t(i)),
again AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT uid, count(DISTINCT p) AS n FROM (SELECT uid, unnest(range(i, i + 5)) AS p FROM again) GROUP BY uid),
counted AS (
    SELECT uid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '{space}+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_capitals,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
    FROM cut LEFT JOIN covered c USING (uid)),
rated AS (
    SELECT *, n_words < {quality.SHORTEST} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed,
        1000 * word_chars // greatest(n_words, 1) AS word_length, 1000 * n_symbols // greatest(n_words, 1) AS symbols,
        1000 * n_capitals // greatest(n_words, 1) AS capitals, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
        1000 * n_repeat_words // greatest(n_words, 1) AS repeats,
        {", ".join(f"{key} AS k{i}" for i, key in levels.items())}
    FROM counted),
sketch AS (
    SELECT k, rate, (v >> d) << d AS bucket, count(*) AS n
    FROM (SELECT *, CAST(greatest(length(bin(v)) - 6, 0) AS BIGINT) AS d FROM ({rows})) GROUP BY ALL),
running AS (
    SELECT *, sum(n) OVER (PARTITION BY k, rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY k, rate) AS total FROM sketch),
quartiles AS (
    SELECT k, rate, max(total) AS total, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (4 * upto >= 3 * total) AS q3
    FROM running GROUP BY ALL),
fences AS (
    SELECT k, rate, total, q1 - {quality.REACH} * s AS low, q3 + {quality.REACH} * s AS high
    FROM (SELECT *, greatest(q3 - q1, CASE rate {floors} END) AS s FROM quartiles)),
totals AS (SELECT k, max(total) AS total FROM fences GROUP BY k),
placed AS (
    SELECT r.*, CASE WHEN a.total >= {quality.GROUP_ROWS} THEN k0 WHEN b.total >= {quality.GROUP_ROWS} THEN k1 ELSE k2 END AS used
    FROM rated r LEFT JOIN totals a ON a.k = k0 LEFT JOIN totals b ON b.k = k1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT EXISTS (SELECT 1 FROM fences f WHERE f.k = r.used AND ({over} OR {under})) AS kept
FROM placed r
"""


ORACLES["op4_adaptive_quality"] = _quality_sql()


@query
def op11_tensored_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Size of every document's shingle set, its component of near-duplicates, and whether it stays."""
    return minhash.near_duplicates(read(spark, folder, "documents").select("doc_id", "text"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op11_tensored_minhash"] = rf"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS words
    FROM documents
), cut AS (
    SELECT uid, doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingles FROM docs
), sized AS (SELECT uid, doc_id, CAST(len(shingles) AS BIGINT) AS n FROM cut),
posted AS (SELECT uid, unnest(shingles) AS s FROM cut),
met AS (
    SELECT a.uid AS u, b.uid AS v, count(*) AS both FROM posted a JOIN posted b ON a.s = b.s AND a.uid < b.uid GROUP BY ALL
), linked AS (
    SELECT u, v FROM met JOIN sized x ON x.uid = u JOIN sized y ON y.uid = v WHERE 100 * met.both >= 80 * (x.n + y.n - met.both)
), edges AS (SELECT u, v FROM linked UNION ALL SELECT v, u FROM linked),
reached AS (
    SELECT DISTINCT u AS node, u AS other FROM edges
    UNION
    SELECT r.node, e.v FROM reached r JOIN edges e ON e.u = r.other
), firsts AS (SELECT node, min(doc_id) AS first FROM reached JOIN sized ON uid = other GROUP BY node)
SELECT doc_id, n AS n_shingles, coalesce(first, doc_id) AS component_id, doc_id IS NOT DISTINCT FROM coalesce(first, doc_id) AS kept
FROM sized LEFT JOIN firsts ON node = uid
"""


@query
def op12_shared_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search.ranked_search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(_LOWER.format("coalesce(text, '')"))

ORACLES["op12_shared_search"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, {_TERMS} AS terms FROM documents),
facts AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_words FROM docs WHERE len(terms) > 0),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
occurs AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(terms) AS term FROM docs) GROUP BY ALL),
wanted AS (SELECT o.* FROM occurs o SEMI JOIN asked USING (term)),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM wanted GROUP BY term), facts
), parts AS (
    SELECT uid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(terms) * n_docs) // n_words))) AS part
    FROM wanted JOIN docs USING (uid) JOIN weights USING (term), facts
), scores AS (
    SELECT item_id, uid, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scores WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 50
"""


@query
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of every source from the others of its language, and the terms that set it apart."""
    return divergence.source_divergence(read(spark, folder, "documents"))


ORACLES["op13_source_divergence"] = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS uid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), counts AS (
    SELECT lang, source, term, count(*) AS c, count(DISTINCT uid) AS n
    FROM (SELECT uid, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL
), kept AS (SELECT lang, term, sum(c)::BIGINT AS c FROM counts GROUP BY ALL HAVING sum(n) >= 3),
own AS (SELECT lang, source, term, counts.c FROM counts SEMI JOIN kept USING (lang, term)),
langs AS (
    SELECT lang, count(term) AS v, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang
), sources AS (
    SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN own USING (lang, source) GROUP BY ALL
), wide AS (
    SELECT s.lang, s.source, k.term, coalesce(o.c, 0) AS in_source,
        1 + (1000000000::HUGEINT * (coalesce(o.c, 0) + 1)) // (s.n + l.v) AS p, 1 + (1000000000::HUGEINT * (k.c + 1)) // (l.n + l.v) AS q
    FROM sources s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = s.lang AND o.source = s.source AND o.term = k.term
), distances AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM wide a JOIN wide b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM wide WHERE in_source > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR place <= {divergence.TOP}
"""
