"""Names, keys, hashes and number formats over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity, names
from ..operators import inventory
from ..session import table
from .registry import query

PATHS = "SELECT doc_id, 'raw/' || source || '/images/' || lang || '/images/' || doc_id || '_' || lang || '.RF.' || md5(doc_id::VARCHAR) || '.jpg' AS path, source, lang, n_chars FROM documents"


def paths(spark, d):
    path = F.concat(F.lit("raw/"), "source", F.lit("/images/"), "lang", F.lit("/images/"), F.col("doc_id").cast("string"), F.lit("_"), "lang", F.lit(".RF."), F.md5(F.col("doc_id").cast("string")), F.lit(".jpg"))
    return table(spark, d, "documents").select("doc_id", path.alias("path"), "source", "lang", "n_chars")


@query(f"""
    WITH p AS ({PATHS}), n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM p)
    SELECT doc_id, name, '.jpg' AS suffix, name[1:length(name) - 4] AS stem, doc_id || '_' || lang AS base, doc_id::VARCHAR AS family,
        CASE WHEN starts_with(name, '1') THEN '1' WHEN starts_with(name, '2') THEN '2' ELSE 'other' END AS prefix,
        'raw/' || source || '/labels/' || lang || '/images/' || name[1:length(name) - 4] || '.txt' AS label, starts_with(path, 'raw/src1/') AS inside
    FROM n
""")
def file_names(spark, d):
    path = F.col("path")
    name = names.basename(path)
    return paths(spark, d).select(
        "doc_id", name.alias("name"), names.suffix(path).alias("suffix"), names.stem(path).alias("stem"), names.export_base(name).alias("base"), names.numeric_family(name).alias("family"),
        names.prefix_family(name, ["1", "2"]).alias("prefix"), names.label_path(path).alias("label"), names.inside(path, F.lit("raw/src1")).alias("inside"),
    )


@query(r"SELECT page_id, CASE WHEN regexp_matches(url, '^https://([^/]*)/') THEN '0:' || regexp_extract(url, '^https://([^/]*)/', 1) WHEN regexp_matches(url, '^http://([^/]*)/') THEN '1:' || regexp_extract(url, '^http://([^/]*)/', 1) ELSE '2:' || url END AS unit FROM pages")
def capture_unit(spark, d):
    unit = names.capture_unit(F.col("url"), ["^https://([^/]*)/", "^http://([^/]*)/", "^(.*)$"])
    return table(spark, d, "pages").select("page_id", unit.alias("unit"))


@query(f"""
    WITH p AS ({PATHS}), h AS (SELECT *, ('0x' || md5(path)[1:16])::UBIGINT::HUGEINT AS u FROM p)
    SELECT doc_id, source || '_' || sha256(path)[1:24] AS export_stem, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS hash,
        bit_count(xor(('0x' || md5(path)[1:16])::UBIGINT, ('0x' || md5(path)[17:32])::UBIGINT))::INTEGER AS apart,
        CASE WHEN n_chars * 37 >= 86400 THEN (n_chars * 37 // 86400) || 'd ' ELSE '' END || printf('%02d:%02d:%02d', n_chars * 37 % 86400 // 3600, n_chars * 37 % 3600 // 60, n_chars * 37 % 60) AS took
    FROM h
""")
def identity_keys(spark, d):
    hexes = F.md5("path")
    first, second = identity.hash_from_hex(F.substring(hexes, 1, 16)), identity.hash_from_hex(F.substring(hexes, 17, 16))
    return paths(spark, d).select("doc_id", identity.export_stem(F.col("source"), F.col("path")).alias("export_stem"), first.alias("hash"), identity.hamming(first, second).alias("apart"), identity.duration(F.col("n_chars") * 37).alias("took"))


JSON = "'\"doc_id\"%s' || doc_id || '%s\"quality\"%s' || coalesce(quality::VARCHAR, 'null') || '%s\"toxic\"%s' || coalesce(toxic::VARCHAR, 'null')"


@query(f"SELECT doc_id, sha256('{{' || {JSON % (':', ',', ':', ',', ':')} || '}}') AS compact, sha256('{{' || {JSON % (': ', ', ', ': ', ', ', ': ')} || '}}') AS spaced FROM labels")
def canonical_json(spark, d):
    value = F.to_json(F.struct("toxic", "quality", "doc_id"), {"ignoreNullFields": "false"})
    return table(spark, d, "labels").select("doc_id", identity.canonical_hash(value).alias("compact"), identity.spaced_hash(value).alias("spaced"))


@query("SELECT l_orderkey, l_linenumber, printf('%.12g', l_extendedprice / 7) AS label, printf('%.10g', l_extendedprice / 7) AS import, printf('%.6f', l_discount / 3) AS exchange FROM lineitem")
def number_text(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", identity.short_number(F.col("l_extendedprice") / 7).alias("label"), identity.import_number(F.col("l_extendedprice") / 7).alias("import"), identity.fixed_number(F.col("l_discount") / 3).alias("exchange"))


@query("""
    WITH t AS (SELECT l_orderkey, l_partkey % 5 || ':' || l_returnflag || '|' || printf('%.10f', round(l_discount / 3, 10)) || ',' || printf('%.10f', round(l_tax / 7, 10)) AS one FROM lineitem)
    SELECT l_orderkey, sha256(string_agg(one, ';' ORDER BY one)) AS signature, count(*) AS boxes FROM t GROUP BY ALL
""")
def annotation_signatures(spark, d):
    one = F.struct((F.col("l_partkey") % 5).alias("target"), F.col("l_returnflag").alias("source"), F.array(F.col("l_discount") / 3, F.col("l_tax") / 7).alias("box"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(one).alias("rows"))
    return rows.select("l_orderkey", F.sha2(F.array_join(identity.annotation_signature(F.col("rows")), ";"), 256).alias("signature"), F.size("rows").cast("long").alias("boxes"))


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS run FROM events")
def run_names(spark, d):
    return table(spark, d, "events").select("event_id", identity.run_stamp(F.col("ts").cast("timestamp")).alias("run"))


@query("SELECT doc_id, coalesce(nullif(trim(text), ''), lang, 'none')[1:40] AS shown FROM documents")
def shown_text(spark, d):
    shown = identity.or_else(F.trim("text"), F.col("lang"), F.lit("none"))
    return table(spark, d, "documents").select("doc_id", F.substring(shown, 1, 40).alias("shown"))


@query("SELECT source, sha256('[' || string_agg('{\"doc_id\":' || doc_id || ',\"md5\":\"' || md5(text) || '\"}', ',' ORDER BY doc_id) || ']') AS identity, count(*) AS rows FROM documents GROUP BY ALL")
def subset_identity(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.md5("text").alias("md5"))
    return inventory.subset_identity(rows, "source", ["doc_id", "md5"])


@query("SELECT o_orderkey, printf('D%d-%05d', o_custkey % 4, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderkey)) AS display FROM orders")
def display_ids(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("dataset"))
    return inventory.display_ids(rows, "dataset", "o_orderkey", "D%d-%05d").select("o_orderkey", "display")
