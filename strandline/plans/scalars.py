"""Queries of filters, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import binary, text
from strandline.operators import lexicon
from strandline.operators.order import unrolled
from strandline.plans.base import Registry, documents, table

R = Registry()
_NORM = r"trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g'))"
_STRIP = r"regexp_replace({}, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g')"
_STRIPPED = _STRIP.format("text")
_EXT = "lower(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([.][^./]*)$', 1))"
_SUPPORTED = "(" + ", ".join(f"'{e}'" for e in text.SUPPORTED) + ")"
_SENT = rf"list_filter(list_transform(regexp_extract_all({_NORM}, '(?s).+?(?:[.!?]+|$)'), lambda x: trim(x)), lambda x: length(x) > 0)"
_SENTENCES = f"SELECT doc_id, unnest(range(len(l))) AS seg_no, unnest(l) AS text FROM (SELECT doc_id, {_SENT} AS l FROM documents)"


def _docs(spark, d):
    return table(spark, d, "documents")


def _exploded(df, pieces):
    return unrolled(df, ["doc_id"], pieces, "seg_no", "text").withColumn("seg_no", F.col("seg_no").cast("long"))


def sentence_rows(spark, d):
    return _exploded(documents(spark, d), text.sentences(F.col("text")))


@R.add("P01_required", f"""SELECT lang, count(*) FILTER (coalesce({_STRIPPED}, '') <> '' AND coalesce(source, '') <> '') AS kept,
    count(*) FILTER (NOT (coalesce({_STRIPPED}, '') <> '' AND coalesce(source, '') <> '')) AS dropped FROM documents GROUP BY lang""")
def required(spark, d):
    ok = ~text.is_blank(F.col("text")) & ~text.is_blank(F.col("source"))
    return _docs(spark, d).groupBy("lang").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


@R.add("P02_extension", f"SELECT page_id, CASE WHEN {_EXT} = '' THEN '.mp3' ELSE {_EXT} END AS ext, {_EXT} IN {_SUPPORTED} OR {_EXT} = '' AS supported FROM pages")
def extension(spark, d):
    e = text.extension(F.col("url"))
    ext = F.when(e == "", ".mp3").otherwise(e)
    return table(spark, d, "pages").select("page_id", ext.alias("ext"), ext.isin(*text.SUPPORTED).alias("supported"))


@R.add("P03_prefixes", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_type, 'STANDARD') OR starts_with(p_type, 'PROMO') OR starts_with(p_name, 'Part')")
def prefixes(spark, d):
    p = table(spark, d, "part")
    return p.filter(F.col("p_type").startswith("STANDARD") | F.col("p_type").startswith("PROMO") | F.col("p_name").startswith("Part")).select("p_partkey", "p_name")


@R.add("P04_keys", "SELECT doc_id, doc_id IN (71, 72, 73) AS listed FROM documents WHERE doc_id IN (71, 72, 73) OR doc_id BETWEEN 7 AND 26")
def keys(spark, d):
    k = F.col("doc_id")
    return _docs(spark, d).filter(k.isin(71, 72, 73) | k.between(7, 26)).select("doc_id", k.isin(71, 72, 73).alias("listed"))


@R.add("P05_padding", """WITH a AS (SELECT event_id, value AS b, value + (user_id % 3 - 1) * 0.1 AS e FROM events),
    p AS (SELECT event_id, greatest(0.0, b - 0.05) AS b, (CASE WHEN e <= b THEN b + 0.25 ELSE e END) + 0.05 AS e FROM a)
    SELECT event_id, round(b, 4) AS begin_s, round(CASE WHEN e <= b THEN b + 0.25 ELSE e END, 4) AS end_s FROM p""")
def padding(spark, d):
    a = table(spark, d, "events").select("event_id", F.col("value").alias("b"), (F.col("value") + (F.col("user_id") % 3 - 1) * 0.1).alias("e"))
    p = a.select("event_id", F.greatest(F.lit(0.0), F.col("b") - 0.05).alias("b"), (F.when(F.col("e") <= F.col("b"), F.col("b") + 0.25).otherwise(F.col("e")) + 0.05).alias("e"))
    end = F.when(F.col("e") <= F.col("b"), F.col("b") + 0.25).otherwise(F.col("e"))
    return p.select("event_id", F.round("b", 4).alias("begin_s"), F.round(end, 4).alias("end_s"))


_N_END = "(length(text) - length(translate(text, '.!?;。！？；', '')))"


@R.add("P06_splittable", f"""SELECT doc_id, {_STRIPPED} <> '' AND length(text) >= 16 AND {_N_END} > 0
    AND NOT ({_N_END} = 1 AND regexp_matches({_STRIPPED}, '[.!?;。！？；]$')) AS splittable FROM documents""")
def splittable(spark, d):
    return _docs(spark, d).select("doc_id", text.splittable(F.col("text")).alias("splittable"))


@R.add("P07_routes", f"SELECT page_id, CASE WHEN {_EXT} = '.mp4' THEN 'head' WHEN {_EXT} IN ('.mp3', '.jpg') THEN 'full' ELSE 'copy' END AS route FROM pages")
def routes(spark, d):
    e = text.extension(F.col("url"))
    return table(spark, d, "pages").select("page_id", F.when(e == ".mp4", "head").when(e.isin(".mp3", ".jpg"), "full").otherwise("copy").alias("route"))


@R.add("P08_failures", f"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://[^/]+') THEN 'failed' WHEN html IS NULL OR html = '' THEN 'failed'
    WHEN {_EXT} <> '' AND {_EXT} NOT IN {_SUPPORTED} THEN 'skipped' WHEN strpos(lower(html), '</html>') = 0 THEN 'failed' ELSE 'ok' END AS status,
    CASE WHEN NOT regexp_matches(url, '^https?://[^/]+') THEN 'bad url' WHEN html IS NULL OR html = '' THEN 'download'
    WHEN {_EXT} <> '' AND {_EXT} NOT IN {_SUPPORTED} THEN 'format' WHEN strpos(lower(html), '</html>') = 0 THEN 'processing' ELSE 'none' END AS reason FROM pages""")
def failures(spark, d):
    e, html = text.extension(F.col("url")), F.col("html")
    reason = (
        F.when(~F.col("url").rlike("^https?://[^/]+"), "bad url").when(html.isNull() | (html == ""), "download")
        .when((e != "") & ~e.isin(*text.SUPPORTED), "format").when(F.instr(F.lower(html), "</html>") == 0, "processing").otherwise("none")
    )
    status = F.when(F.col("reason") == "none", "ok").when(F.col("reason") == "format", "skipped").otherwise("failed")
    return table(spark, d, "pages").select("page_id", reason.alias("reason")).select("page_id", status.alias("status"), "reason")


@R.add("P09_affine", "SELECT s_suppkey, (32 + trunc(s_acctbal / 0.5556))::INT AS f FROM supplier")
def affine(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", (F.lit(32) + (F.col("s_acctbal") / 0.5556).cast("int")).alias("f"))


_SAFE = "replace(CASE WHEN trim(left(trim(regexp_replace({0}, '[^a-zA-Z0-9 _-]', '', 'g')), 24)) = '' THEN 'segment' ELSE trim(left(trim(regexp_replace({0}, '[^a-zA-Z0-9 _-]', '', 'g')), 24)) END, ' ', '_')"


@R.add("P10_names", f"SELECT doc_id, lpad((doc_id % 1000)::VARCHAR, 3, '0') || '_' || {_SAFE.format('text')} || '.wav' AS file, 'ID_' || doc_id AS folder FROM documents")
def names(spark, d):
    name = F.concat(F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.lit("_"), text.file_name(F.col("text")), F.lit(".wav"))
    return _docs(spark, d).select("doc_id", name.alias("file"), F.concat(F.lit("ID_"), F.col("doc_id").cast("string")).alias("folder"))


@R.add("P11_previews", "SELECT doc_id, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS preview, left(text, 40) || '...' AS always FROM documents")
def previews(spark, d):
    return _docs(spark, d).select("doc_id", text.preview(F.col("text")).alias("preview"), F.concat(F.left(F.col("text"), F.lit(40)), F.lit("...")).alias("always"))


@R.add("P12_classes", "SELECT p_partkey, min(p_partkey) OVER w AS class, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand, p_type, p_size)")
def format_classes(spark, d):
    """Parts of equal formats by their class, whose name is its smallest key: no pairs, and a hot class
    is summed up before it is shuffled."""
    rows, formats = table(spark, d, "part"), ("p_brand", "p_type", "p_size")
    classes = rows.groupBy(*formats).agg(F.min("p_partkey").alias("class"), F.count("*").alias("n")).alias("c")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in formats]
    return rows.alias("r").join(classes, same).select("r.p_partkey", "c.class", "c.n")


@R.add("P13_short", "SELECT vec_id, CASE WHEN len(embedding) = 0 THEN 'empty' WHEN len(embedding) / 640.0 < 0.1 THEN 'too short' WHEN embedding[1] < -0.1 THEN 'quiet' ELSE 'ok' END AS verdict FROM embeddings")
def short(spark, d):
    n = F.size("embedding")
    verdict = F.when(n == 0, "empty").when(n / 640.0 < 0.1, "too short").when(F.col("embedding")[0] < -0.1, "quiet").otherwise("ok")
    return table(spark, d, "embeddings").select("vec_id", verdict.alias("verdict"))


@R.add("P14_labels", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'finished' WHEN 'P' THEN 'partial' ELSE 'unknown' END AS label FROM orders")
def labels(spark, d):
    codes = F.create_map(*[F.lit(x) for x in ("O", "open", "F", "finished", "P", "partial")])
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(codes[F.col("o_orderstatus")], F.lit("unknown")).alias("label"))


@R.add("T01_normalise", f"SELECT doc_id, {_NORM} AS text FROM documents")
def normalised(spark, d):
    return _docs(spark, d).select("doc_id", text.normalise(F.col("text")).alias("text"))


R.add("T02_sentences", _SENTENCES)(sentence_rows)


@R.add("T03_secondary", f"""SELECT doc_id, seg_no, unnest(range(len(p))) AS part_no, unnest(p) AS part FROM (SELECT doc_id, seg_no,
    CASE WHEN length(text) > 80 THEN list_filter(list_transform(regexp_extract_all(text, '(?s)[^,:;]*[,:;]+|[^,:;]+$'), lambda x: {_STRIP.format('x')}), lambda x: length(x) > 0) ELSE [text] END AS p FROM ({_SENTENCES}))""")
def secondary(spark, d):
    return sentence_rows(spark, d).select("doc_id", "seg_no", F.posexplode(text.secondary(F.col("text"))).alias("part_no", "part")).withColumn("part_no", F.col("part_no").cast("long"))


@R.add("T04_packed")
def packed(spark, d):
    return _exploded(documents(spark, d), text.packed(text.normalise(F.col("text"))))


@R.add("T05_clauses", rf"""SELECT doc_id, unnest(range(len(l))) AS seg_no, unnest(l) AS text FROM (SELECT doc_id, list_filter(list_transform(
    regexp_extract_all(text, '(?s)[^,.!?;。！？；]*[,.!?;。！？；]|[^,.!?;。！？；]+$'), lambda x: {_STRIP.format('x')}), lambda x: length(x) > 0) AS l FROM documents)""")
def clauses(spark, d):
    return _exploded(documents(spark, d), text.clauses(F.col("text")))


@R.add("T06_positioned")
def positioned(spark, d):
    rows = unrolled(documents(spark, d), ["doc_id"], text.positioned(F.col("text")), "seg_no", "s")
    return rows.select("doc_id", "seg_no", "s.*")


_FEATURES = "CASE WHEN regexp_matches(text, '[!?！？]$') OR length(text) < 16 THEN concat_ws(',', CASE WHEN regexp_matches(text, '[!?！？]$') THEN 'intonation' END, CASE WHEN length(text) < 16 THEN 'short' END) ELSE 'plain' END"
_EXTRA = "((CASE WHEN regexp_matches(text, '[!?！？]$') THEN 50000 ELSE 0 END) + (CASE WHEN length(text) < 16 THEN 100000 ELSE 0 END))::BIGINT"


@R.add("T07_features", f"SELECT doc_id, seg_no, {_FEATURES} AS features, {_EXTRA} AS extra_us FROM ({_SENTENCES})")
def features(spark, d):
    return sentence_rows(spark, d).select("doc_id", "seg_no", F.array_join(text.features(F.col("text")), ",").alias("features"), text.extra_time_us(F.col("text")).alias("extra_us"))


@R.add("T08_breaks", r"SELECT doc_id, regexp_matches(text, '[.!?;。！？；][ \t\r\n\f]*$') AS natural FROM documents")
def breaks(spark, d):
    return _docs(spark, d).select("doc_id", text.natural_break(F.col("text")).alias("natural"))


_RATIO = "((length(text) - length(translate(text, ',.!?;。！？；', '')))::DOUBLE / greatest(length(text), 1))"


@R.add("T09_punctuation", f"SELECT doc_id, round({_RATIO}, 6) AS ratio, {_RATIO} < 0.02 AS low FROM documents")
def punctuation(spark, d):
    r = text.punctuation_ratio(F.col("text"))
    return _docs(spark, d).select("doc_id", F.round(r, 6).alias("ratio"), (r < 0.02).alias("low"))


_W = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"
_TOKENS = rf"""SELECT doc_id, word, (e - length(word))::INT AS start_pos, e::INT AS end_pos FROM (
    SELECT doc_id, word, sum(length(word)) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS e FROM (
      SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS word FROM (SELECT doc_id,
        regexp_extract_all(text, '(?s){_W}(?:[\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}'']*{_W})?|[^\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}]+') AS l FROM SRC)))
    WHERE regexp_matches(word, '^{_W}')"""


def token_rows(df):
    return lexicon.tokens(df, "doc_id")


@R.add("T10_tokens", _TOKENS.replace("SRC", "(SELECT item_id AS doc_id, text FROM benchmark)"))
def tokens(spark, d):
    return token_rows(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))


@R.add("T10_documents", _TOKENS.replace("SRC", "documents"))
def document_tokens(spark, d):
    return token_rows(documents(spark, d).select("doc_id", "text"))


_LINES = r"SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\r\n]+'), lambda x: trim(x) <> '') AS l FROM documents)"


def line_rows(spark, d):
    lines = F.filter(F.split(F.col("text"), r"[\r\n]+"), lambda x: F.trim(x) != "")
    return unrolled(documents(spark, d), ["doc_id"], lines, "line_no", "line").withColumn("line_no", F.col("line_no").cast("long"))


R.add("S06_lines", _LINES)(line_rows)


@R.add("T11_head_rest", f"SELECT doc_id, line_no, string_split(line, ' ')[1] AS word, array_to_string(string_split(line, ' ')[2:], '') AS meaning FROM ({_LINES})")
def head_rest(spark, d):
    head, rest = text.head_rest(F.col("line"))
    return line_rows(spark, d).select("doc_id", "line_no", head.alias("word"), rest.alias("meaning"))


@R.add("T12_file_names", f"SELECT doc_id, {_SAFE.format('text')} AS name FROM documents")
def file_names(spark, d):
    return _docs(spark, d).select("doc_id", text.file_name(F.col("text")).alias("name"))


@R.add("T13_directories", r"""SELECT page_id, regexp_replace(left(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), 50), '^[_. ]+|[_. ]+$', '', 'g') AS name FROM pages""")
def directories(spark, d):
    return table(spark, d, "pages").select("page_id", text.directory_name(F.col("url")).alias("name"))


@R.add("T14_hex", "SELECT doc_id, hex(encode(text)) AS hexed, text AS back FROM documents")
def hexed(spark, d):
    h = F.hex(F.encode(F.col("text"), "UTF-8"))
    return _docs(spark, d).select("doc_id", h.alias("hexed")).withColumn("back", F.decode(binary.from_hex(F.col("hexed")), "UTF-8"))


@R.add("T15_base64", "SELECT doc_id, base64(encode(text)) AS coded FROM documents")
def base64(spark, d):
    return _docs(spark, d).select("doc_id", F.replace(F.base64(F.encode(F.col("text"), "UTF-8")), F.lit("\r\n"), F.lit("")).alias("coded"))


@R.add("T16_requests", """SELECT conv_id, turn, '{"user":{"uid":"' || conv_id || '"},"request":{"turn":' || turn || ',"role":"' || role || '","size":' || length(text) || '}}' AS body FROM conversations""")
def requests(spark, d):
    body = F.to_json(F.struct(F.struct(F.col("conv_id").cast("string").alias("uid")).alias("user"), F.struct("turn", "role", F.length("text").alias("size")).alias("request")))
    return table(spark, d, "conversations").select("conv_id", "turn", body.alias("body"))


@R.add("T17_markers", "SELECT event_id, (props::JSON ->> '$.k')::INT % 100 = 0 OR (props::JSON ->> '$.k')::INT IN (200, 300) AS ends FROM events")
def markers(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", ((k % 100 == 0) | k.isin(200, 300)).alias("ends"))


_KEY = "0123456789abcdef0123456789abcdef"


@R.add("T18_encrypt_text", "SELECT doc_id, text, (length(encode(text)) // 16 + 1) * 32 AS hex_length FROM documents".replace("length(encode(text))", "octet_length(encode(text))"))
def encrypt_text(spark, d):
    out = _docs(spark, d).select("doc_id", F.hex(binary.encrypt(F.encode(F.col("text"), "UTF-8"), _KEY, True)).alias("code"))
    return out.select("doc_id", F.decode(binary.decrypt(F.unhex("code"), _KEY, True), "UTF-8").alias("text"), F.length("code").cast("long").alias("hex_length"))


@R.add("T19_encrypt_blobs", "SELECT doc_id, sha256(encode(text)) AS digest FROM documents")
def encrypt_blobs(spark, d):
    blob = binary.decrypt(binary.encrypt(F.encode(F.col("text"), "UTF-8"), _KEY), _KEY)
    return _docs(spark, d).select("doc_id", F.sha2(blob, 256).alias("digest"))


@R.add("T20_encrypt_heads", "SELECT doc_id, octet_length(encode(text)) + 16 AS stored, sha256(encode(text)) AS digest FROM documents WHERE octet_length(encode(text)) >= 16")
def encrypt_heads(spark, d):
    out = _docs(spark, d).select("doc_id", binary.encrypt_head(F.encode(F.col("text"), "UTF-8"), _KEY).alias("b")).filter("b is not null")
    return out.select("doc_id", F.length("b").cast("long").alias("stored"), F.sha2(binary.decrypt_head(F.col("b"), _KEY), 256).alias("digest"))


@R.add("T21_numbers", "SELECT event_id, coalesce(try_cast(props::JSON ->> '$.k' AS DOUBLE), 0) AS k, coalesce(try_cast(event_type AS DOUBLE), 0) AS bad FROM events")
def numbers(spark, d):
    return table(spark, d, "events").select("event_id", text.number_or(F.get_json_object("props", "$.k")).alias("k"), text.number_or(F.col("event_type")).alias("bad"))


@R.add("T22_shares", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 0)::BIGINT AS share FROM lineitem")
def shares(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 4, 0).cast("long").alias("share"))


@R.add("T23_integers", "SELECT event_id, ((event_id * 2654435761) % 4294967296 - CASE WHEN (event_id * 2654435761) % 4294967296 >= 2147483648 THEN 4294967296 ELSE 0 END)::INT AS n, (event_id % 256 // 16)::INT AS high, (event_id % 16)::INT AS low FROM events")
def integers(spark, d):
    raw = F.concat(F.unhex(F.lpad(F.hex(F.col("event_id") % 256), 2, "0")), binary.four_bytes(F.pmod(F.col("event_id") * 2654435761, F.lit(1 << 32))))
    rows = table(spark, d, "events").select("event_id", raw.alias("b"))
    first = binary.byte_at(F.col("b"), 1)
    return rows.select("event_id", binary.int32(F.col("b"), 2).alias("n"), F.shiftright(first, 4).alias("high"), first.bitwiseAND(15).alias("low"))


@R.add("T24_slices", f"SELECT doc_id, array_to_string(string_split({_NORM}, ' ')[4:10], ' ') AS words FROM documents")
def slices(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(F.slice(F.split(text.normalise(F.col("text")), " "), 4, 7), " ").alias("words"))


@R.add("T25_lists", f"SELECT page_id % 5 AS grp, array_to_string(list_sort(list_distinct(list(upper(ltrim({_EXT}, '.'))))), ', ') AS formats FROM pages GROUP BY 1")
def lists(spark, d):
    pages = table(spark, d, "pages").select((F.col("page_id") % 5).alias("grp"), text.extension(F.col("url")).alias("e"))
    return pages.groupBy("grp").agg(text.listed(F.array_sort(F.collect_set("e"))).alias("formats"))


_FRAME = "'11B41000' || lpad(hex(352 + event_id % 2), 8, '0') || lpad(hex(octet_length(encode(user_id::VARCHAR))), 8, '0') || hex(encode(user_id::VARCHAR)) || lpad(hex(octet_length(encode(props))), 8, '0') || hex(encode(props))"


@R.add("T26_frames", f"SELECT event_id, {_FRAME} AS frame FROM events")
def frames(spark, d):
    f = binary.frame(0xB, 4, 1, 352 + F.col("event_id") % 2, F.encode(F.col("user_id").cast("string"), "UTF-8"), F.encode("props", "UTF-8"))
    return table(spark, d, "events").select("event_id", F.hex(f).alias("frame"))
