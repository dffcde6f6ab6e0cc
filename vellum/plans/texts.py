"""Text, label, identifier and bibliography functions over the test tables, with the SQL that gives the same rows.

Texts that the tables lack (Greek words, tags, names, addresses) are made from
their keys and words by the same rule on either side.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bibliography, identifiers, normalize, scheme, text as fx
from .queries import TOKENS, query, table, tokens
from .streams import ITEMS, items

FORMS = f"{TOKENS}, forms AS (SELECT form, CASE WHEN length(form) % 4 = 0 THEN 'la-x' WHEN length(form) % 4 = 1 THEN 'he' ELSE 'en' END AS lang, count(*) AS n FROM tokens GROUP BY form)"


def forms(spark, sf_dir):  # noqa: ANN001, ANN201
    """Distinct words with a language that follows from their length."""
    n = F.length("form") % 4
    return tokens(spark, sf_dir).groupBy("form").agg(F.count("*").alias("n")).withColumn("lang", F.when(n == 0, "la-x").when(n == 1, "he").otherwise("en"))


@query(f"""WITH {FORMS} SELECT form, CASE WHEN lang = 'la-x' THEN replace(replace(f, 'v', 'u'), 'j', 'i') WHEN lang = 'he' THEN strip_accents(f) ELSE f END AS fold FROM (SELECT form, lang, lower(regexp_replace(form, '[\\pP\\pS]', '', 'g')) AS f FROM forms)""")
def default_fold(spark, sf_dir):  # noqa: ANN001, ANN201
    return forms(spark, sf_dir).select("form", fx.fold("form", "lang").alias("fold"))


@query(f"""WITH {FORMS} SELECT w AS form, CASE WHEN lang = 'la-x' THEN replace(replace(f, 'v', 'u'), 'j', 'i') WHEN lang = 'he' THEN strip_accents(f) ELSE f END AS key
FROM (SELECT w, lang, regexp_replace(translate(lower(w), 'àèìòù', 'áéíóú'), '[''ʼ’᾽′]', '’', 'g') AS f FROM (SELECT CASE WHEN n % 3 = 0 THEN form || '''' WHEN n % 3 = 1 THEN form || '′' ELSE form END AS w, lang FROM forms))""")
def agreement_fold(spark, sf_dir):  # noqa: ANN001, ANN201
    w = F.when(F.col("n") % 3 == 0, F.concat("form", F.lit("'"))).when(F.col("n") % 3 == 1, F.concat("form", F.lit("′"))).otherwise(F.col("form"))
    return forms(spark, sf_dir).select(w.alias("form"), fx.agreement(w, "lang").alias("key"))


@query(f"""WITH {FORMS} SELECT form, replace(replace(upper(replace(regexp_replace(strip_accents(form), '[^\\pL]', '', 'g'), 'ß', 'ss')), 'V', 'U'), 'J', 'I') AS letters FROM forms""")
def archetype_letters(spark, sf_dir):  # noqa: ANN001, ANN201
    return forms(spark, sf_dir).select("form", fx.archetype_letters("form").alias("letters"))


@query(f"""WITH {FORMS}, f AS (SELECT form, lower(regexp_replace(form, '[\\pP\\pS]', '', 'g')) AS fold FROM forms)
SELECT fold, count(*) AS n, min(form) AS first_form, max(form) AS last_form FROM f GROUP BY fold HAVING count(*) > 1""")
def differ_only_in_fold(spark, sf_dir):  # noqa: ANN001, ANN201
    """Folds that more than one form has, told by the first and the last."""
    folded = forms(spark, sf_dir).select("form", fx.fold_plain("form").alias("fold")).groupBy("fold").agg(F.count("*").alias("n"), F.min("form").alias("first_form"), F.max("form").alias("last_form"))
    return folded.where(fx.differ_only_in_fold(F.col("first_form"), F.col("last_form"), F.col("fold"), F.col("fold")))


EDGE_SQL = "[-,.;:!?·…–—()«»“”\"\\[\\]]"


@query(f"""WITH {FORMS} SELECT w, CASE WHEN s = '' THEN w ELSE s END AS at_start, CASE WHEN e = '' THEN w ELSE e END AS at_end FROM (
SELECT w, ltrim(regexp_replace(w, '^{EDGE_SQL}+', '')) AS s, rtrim(regexp_replace(w, '{EDGE_SQL}+$', '')) AS e FROM (SELECT '(' || form || '’ ,' AS w FROM forms))""")
def trim_punctuation_at(spark, sf_dir):  # noqa: ANN001, ANN201
    w = forms(spark, sf_dir).select(F.concat(F.lit("("), "form", F.lit("’ ,")).alias("w"))
    return w.select("w", fx.trim_punctuation_at("w", "start").alias("at_start"), fx.trim_punctuation_at("w", "end").alias("at_end"))


@query(f"""WITH {FORMS} SELECT form, l <> '' AND upper(l) = l AND lower(l) <> l AS caps FROM (SELECT form, regexp_replace(form, '[^\\pL]', '', 'g') AS l FROM forms) WHERE form NOT LIKE '%ß%'""")
def all_caps(spark, sf_dir):  # noqa: ANN001, ANN201
    return forms(spark, sf_dir).where(~F.col("form").contains("ß")).select("form", fx.is_all_caps("form").alias("caps"))


LATIN, GREEK = "abcdefghiklmnopqrstuwxyz", "αβγδεζηθικλμνξοπρστυφχψω"
GREEK_SQL = f"translate(lower(strip_accents(form)), '{LATIN}', '{GREEK}')"


@query(f"""WITH {FORMS} SELECT word, regexp_replace(regexp_replace(word, '[^α-ω]', '', 'g'), 'σ$', 'ς') AS loose, regexp_replace(word, '[0-9]+$', '') AS lemma FROM (SELECT {GREEK_SQL} || n AS word FROM forms)""")
def greek_keys(spark, sf_dir):  # noqa: ANN001, ANN201
    word = F.concat(F.translate(F.lower(fx.strip_diacritics("form")), LATIN, GREEK), F.col("n").cast("string"))
    words = forms(spark, sf_dir).select(word.alias("word"))
    return words.select("word", normalize.loose_key("word").alias("loose"), normalize.lemma_key("word").alias("lemma"))


@query(f"""WITH {FORMS} SELECT w, regexp_replace(regexp_replace(w, 'σ([^\\pL])', 'ς\\1', 'g'), 'σ$', 'ς') AS low FROM (SELECT {GREEK_SQL} || '.' AS w FROM forms)""")
def greek_lower(spark, sf_dir):  # noqa: ANN001, ANN201
    w = forms(spark, sf_dir).select(F.concat(F.translate(F.lower(fx.strip_diacritics("form")), LATIN, GREEK), F.lit(".")).alias("w"))
    return w.select("w", fx.greek_lower(F.upper("w")).alias("low"))


CAPS = "l <> '' AND upper(l) = l AND lower(l) <> l"
PROPOSE = f"""{ITEMS}, t AS (SELECT doc_id, id, h, form, norm, unchecked, CASE WHEN h = 40 THEN form || 'us' ELSE form END AS e, lang FROM items WHERE kind = 'token' AND form NOT LIKE '%ß%'),
low AS (SELECT *, CASE WHEN {CAPS} THEN lower(e) ELSE e END AS o FROM (SELECT *, regexp_replace(e, '[^\\pL]', '', 'g') AS l FROM t)),
rule AS (SELECT *, CASE WHEN lang = 'la' THEN translate(o, 'vjVJ', 'uiUI') ELSE o END AS r FROM low)"""


def _open_items(spark, sf_dir):  # noqa: ANN001, ANN202
    h = (7 * F.length("form") + 3 * F.split_part("id", F.lit("."), F.lit(1)).cast("int") + F.split_part("id", F.lit("."), F.lit(2)).cast("int") - 1) % 100
    abbr = F.struct(F.lit("abbr").alias("kind"), F.create_map(F.lit("expan"), F.lit("us")).alias("attrs"), F.length("form").alias("from"), F.length("form").alias("to"))
    rows = items(spark, sf_dir).where("kind = 'token'").where(~F.col("form").contains("ß")).withColumn("h", h)
    return rows.withColumn("marks", F.when(F.col("h") == 40, F.array(abbr)).otherwise(F.array().cast("array<struct<kind:string,attrs:map<string,string>,from:int,to:int>>")))


@query(f"WITH {PROPOSE} SELECT doc_id, id, r AS proposed FROM rule WHERE r <> form")
def propose_read_form(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = _open_items(spark, sf_dir)
    return rows.withColumn("proposed", normalize.proposed_form(F.col("form"), F.col("marks"), F.col("lang"))).where("proposed IS NOT NULL").select("doc_id", "id", "proposed")


MEMORY = """c AS (SELECT form, coalesce(norm, form) AS norm, doc_id * 1000000 + pos AS "at" FROM items WHERE kind = 'token' AND h BETWEEN 20 AND 25),
last AS (SELECT form, arg_max(norm, "at") AS norm FROM c GROUP BY form), mem AS (SELECT l.form, l.norm, count(*) AS n FROM last l JOIN c ON c.form = l.form
  WHERE c."at" > coalesce((SELECT max(x."at") FROM c x WHERE x.form = l.form AND x.norm <> l.norm), -1) GROUP BY l.form, l.norm)"""


def _memory(rows):  # noqa: ANN001, ANN202
    confirmed = rows.withColumn("h", (7 * F.length("form") + 3 * F.split_part("id", F.lit("."), F.lit(1)).cast("int") + F.split_part("id", F.lit("."), F.lit(2)).cast("int") - 1) % 100)
    confirmed = confirmed.where("kind = 'token' AND h BETWEEN 20 AND 25")
    return normalize.memory(confirmed.select("form", F.coalesce("norm", "form").alias("norm"), (F.col("doc_id") * 1000000 + F.col("pos")).alias("at")))


@query(f"WITH {ITEMS}, {MEMORY} SELECT form, norm, n FROM mem")
def normalization_memory(spark, sf_dir):  # noqa: ANN001, ANN201
    return _memory(items(spark, sf_dir))


@query(f"""WITH {PROPOSE}, {MEMORY}, p AS (SELECT r.*, m.norm AS held, coalesce(m.norm, CASE WHEN r.r <> r.form THEN r.r END) AS new FROM rule r LEFT JOIN mem m ON m.form = r.form WHERE r.norm IS NULL OR r.unchecked)
SELECT doc_id, id, form, new AS norm, CASE WHEN held IS NOT NULL THEN 'memory' ELSE 'profile' END AS source FROM p WHERE new IS NOT NULL AND (unchecked OR new <> coalesce(norm, form)) AND NOT (norm IS NOT NULL AND unchecked)""")
def propose_norms(spark, sf_dir):  # noqa: ANN001, ANN201
    return normalize.proposals(_open_items(spark, sf_dir), _memory(items(spark, sf_dir)))


@query("""WITH p AS (SELECT l_orderkey AS key, l_linenumber AS line, l_returnflag AS form, l_suppkey::VARCHAR AS lemma,
  CASE l_returnflag WHEN 'A' THEN 'v3spia---' WHEN 'N' THEN 'n-s---mn-' ELSE 'd--------' END AS postag, CASE WHEN l_linestatus = 'O' THEN 'treebank' ELSE 'morpheus' END AS source FROM lineitem)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY line, form, lemma, postag, source) - 1 AS nth, form, lemma, postag, source,
  CASE postag[1] WHEN 'v' THEN 'verb, 3rd person singular present indicative active' WHEN 'n' THEN 'noun, singular masculine nominative' ELSE 'adverb' END AS described, CASE postag[1] WHEN 'v' THEN 'verb' WHEN 'n' THEN 'noun' ELSE 'adverb' END AS part FROM p""")
def analyses(spark, sf_dir):  # noqa: ANN001, ANN201
    tag = F.when(F.col("l_returnflag") == "A", "v3spia---").when(F.col("l_returnflag") == "N", "n-s---mn-").otherwise("d--------")
    line = F.concat_ws("\t", "l_returnflag", F.col("l_suppkey").cast("string"), tag, F.when(F.col("l_linestatus") == "O", "treebank").otherwise("morpheus"))
    packed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t")))), lambda x: x["t"]), "\n").alias("packed"))
    return normalize.analyses(packed, "key", "packed").select("key", F.col("line").cast("long").alias("nth"), "form", "lemma", "postag", "source", normalize.describe_postag("postag").alias("described"), normalize.part_of_speech("postag").alias("part"))


BOOK_LINE = [scheme.Level("book"), scheme.Level("line")]
PAGE_SECTION = [scheme.Level("page"), scheme.Level("section", "text", "")]


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN m = 0 THEN l_orderkey || '.' || l_linenumber || 'a' ELSE l_orderkey || '' END AS label,
  lpad(l_orderkey::VARCHAR, 8, '0') || '.' || CASE WHEN m = 0 THEN lpad(l_linenumber::VARCHAR, 8, '0') || 'a' ELSE '00000000' END AS sort_key FROM (SELECT *, l_partkey % 2 AS m FROM lineitem)""")
def format_label(spark, sf_dir):  # noqa: ANN001, ANN201
    line = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.col("l_linenumber").cast("string"), F.lit("a"))).otherwise("")
    address = F.create_map(F.lit("book"), F.col("l_orderkey").cast("string"), F.lit("line"), line)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scheme.format_label(BOOK_LINE, address).alias("label"), scheme.address_key(BOOK_LINE, address).alias("sort_key"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 4 WHEN 0 THEN l_orderkey || chr((97 + l_linenumber)::INT) || ' ' WHEN 1 THEN l_orderkey::VARCHAR WHEN 2 THEN 'x' || l_linenumber ELSE l_orderkey || 'b' || l_linenumber END AS label FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN regexp_extract(trim(label), '^(\\d+)([^\\d].*)$', 1) END AS page, CASE WHEN ok THEN regexp_extract(trim(label), '^(\\d+)([^\\d].*)$', 2) END AS section FROM (SELECT *, regexp_matches(trim(label), '^\\d+[^\\d].*$') AS ok FROM l)""")
def parse_address(spark, sf_dir):  # noqa: ANN001, ANN201
    k, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    label = F.when(F.col("l_partkey") % 4 == 0, F.concat(k, F.char(F.col("l_linenumber") + 97), F.lit(" "))).when(F.col("l_partkey") % 4 == 1, k).when(F.col("l_partkey") % 4 == 2, F.concat(F.lit("x"), n)).otherwise(F.concat(k, F.lit("b"), n))
    rows = table(spark, sf_dir, "lineitem").withColumn("a", scheme.parse_label(PAGE_SECTION, label))
    return rows.select("l_orderkey", "l_linenumber", F.col("a")["page"].alias("page"), F.col("a")["section"].alias("section"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 50)::VARCHAR END AS book, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 100)::VARCHAR END AS line FROM orders),
f AS (SELECT *, last_value(CASE WHEN line IS NOT NULL THEN book END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS b FROM s)
SELECT o_orderkey, CASE WHEN line IS NOT NULL AND b IS NOT NULL THEN b || '.' || line END AS label FROM f""")
def resolve_starts(spark, sf_dir):  # noqa: ANN001, ANN201
    starts = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 50).cast("string")).alias("book"), F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 100).cast("string")).alias("line"))
    return scheme.resolve_starts(starts, BOOK_LINE, "o_custkey", "o_orderkey").select("o_orderkey", "label")


@query("""SELECT l_orderkey, l_linenumber, l_orderkey || ',' || l_linenumber AS new_label, lpad(l_orderkey::VARCHAR, 8, '0') || '.' || rpad(l_linenumber::VARCHAR, 8, ' ') AS new_key FROM lineitem""")
def relabel(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("label"))
    new = [scheme.Level("part"), scheme.Level("item", "text", ",")]
    return scheme.relabel(rows, BOOK_LINE, new, "label").select("l_orderkey", "l_linenumber", "new_label", "new_key")


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS i FROM lineitem WHERE l_partkey % 3 <> 0), r AS (SELECT l_orderkey, min(i) AS a, max(i) AS b FROM (SELECT *, i - row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS g FROM d) GROUP BY l_orderkey, g)
SELECT l_orderkey, string_agg(CASE WHEN a = b THEN '1.' || a ELSE '1.' || a || '–1.' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY l_orderkey""")
def label_ranges(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = table(spark, sf_dir, "lineitem").where("l_partkey % 3 != 0").select("l_orderkey", F.col("l_linenumber").alias("i")).distinct()
    return scheme.label_ranges(rows.withColumn("label", F.concat(F.lit("1."), F.col("i").cast("string"))), ["l_orderkey"], "i", "label")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN 'urn:cts:lib:w' || l_suppkey || ':' || l_orderkey || CASE WHEN l_partkey % 2 = 0 THEN '.' || l_linenumber ELSE '' END END AS urn FROM lineitem""")
def passage_urn(spark, sf_dir):  # noqa: ANN001, ANN201
    work = F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit(" urn:cts:lib:w"), F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("urn:nbn:"), F.col("l_suppkey").cast("string")))
    levels = [F.col("l_orderkey").cast("string"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_linenumber").cast("string")).otherwise(" "), F.when(F.col("l_partkey") % 2 != 0, "9")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", identifiers.passage_urn(work, levels).alias("urn"))


@query("""SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN CASE WHEN o_orderkey > 0 THEN 'Q' || o_orderkey END WHEN 1 THEN o_orderkey::VARCHAR WHEN 3 THEN 'https://a.org/' || o_orderkey WHEN 4 THEN 'urn:cts:a:' || o_orderkey END AS value,
  CASE o_custkey % 5 WHEN 0 THEN CASE WHEN o_orderkey > 0 THEN 'https://www.wikidata.org/wiki/Q' || o_orderkey END WHEN 1 THEN 'https://viaf.org/viaf/' || o_orderkey WHEN 3 THEN 'https://a.org/' || o_orderkey END AS href FROM orders""")
def normal_identifiers(spark, sf_dir):  # noqa: ANN001, ANN201
    k, kind = F.col("o_orderkey").cast("string"), F.col("o_custkey") % 5
    named = F.when(kind == 0, "wikidata").when(kind == 1, "viaf").when(kind == 2, "diktyon").when(kind == 3, "url").otherwise("cts")
    value = F.when(kind == 0, F.concat(F.lit(" q"), k)).when(kind == 1, k).when(kind == 2, F.concat(k, F.lit("x"))).when(kind == 3, F.concat(F.lit("https://a.org/"), k)).otherwise(F.concat(F.lit("urn:cts:a:"), k))
    return table(spark, sf_dir, "orders").select("o_orderkey", identifiers.normal_identifier(named, value).alias("value"), identifiers.identifier_href(named, value).alias("href"))


@query("""WITH d AS (SELECT o_orderkey, lpad((o_orderkey * 7919)::VARCHAR, 15, '0') AS d FROM orders),
t AS (SELECT *, (12 - list_reduce(list_prepend(0, [x::BIGINT for x in string_split(d, '')]), lambda s, x: ((s + x) * 2) % 11) % 11) % 11 AS r FROM d)
SELECT o_orderkey, CASE WHEN r = o_orderkey % 11 THEN left(d, 4) || '-' || d[5:8] || '-' || d[9:12] || '-' || d[13:15] || CASE WHEN r = 10 THEN 'X' ELSE r::VARCHAR END END AS orcid FROM t""")
def normal_orcid(spark, sf_dir):  # noqa: ANN001, ANN201
    """Numbers with a check character that is right for one in eleven."""
    d = F.lpad((F.col("o_orderkey") * 7919).cast("string"), 15, "0")
    check = F.when(F.col("o_orderkey") % 11 == 10, "x").otherwise((F.col("o_orderkey") % 11).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", identifiers.normal_orcid(F.concat(F.lit("https://orcid.org/"), d, check)).alias("orcid"))


@query("""WITH v AS (SELECT s_suppkey, ['https://creativecommons.org/licenses/by/4.0/', 'https://creativecommons.org/licenses/by-nc-sa/4.0/', 'http://rightsstatements.org/vocab/InC/1.0/', 'http://rightsstatements.org/vocab/NoC-NC/1.0/', NULL][1 + s_suppkey % 5] AS uri FROM supplier)
SELECT s_suppkey, uri AS rights, coalesce(uri NOT LIKE '%InC%', false) AS copyable, CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN s_nationkey % 3 > 0 ELSE s_nationkey % 3 = 2 END AS compatible FROM v JOIN supplier USING (s_suppkey)""")
def rights(spark, sf_dir):  # noqa: ANN001, ANN201
    given = F.array(*[F.lit(x) for x in ("http://creativecommons.org/licenses/by/4.0/deed.en", "https://creativecommons.org/licenses/BY-NC-SA/4.0", "https://rightsstatements.org/vocab/InC/1.0/", "http://rightsstatements.org/vocab/NoC-NC/1.0", "https://creativecommons.org/licenses/by/3.0/")])
    licences = F.array(*[F.lit(x) for x in ("CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")])
    found = table(spark, sf_dir, "supplier").withColumn("rights", identifiers.normal_rights(F.get(given, (F.col("s_suppkey") % 5).cast("int"))))
    fits = identifiers.licence_compatible(F.get(licences, (F.col("s_suppkey") % 3).cast("int")), F.get(licences, (F.col("s_nationkey") % 3).cast("int")))
    return found.select("s_suppkey", "rights", identifiers.is_copyable("rights").alias("copyable"), fits.alias("compatible"))


@query("""WITH a AS (SELECT c_custkey AS k, [{'scheme': 'url', 'value': 'v' || c_custkey % 7}, {'scheme': 'url', 'value': 'v' || c_custkey % 5}] AS a, [{'scheme': 'url', 'value': 'v' || c_custkey % 3}, {'scheme': 'url', 'value': 'v' || c_custkey % 7}] AS b FROM customer),
x AS (SELECT k, unnest(list_concat(a, b)) AS i, generate_subscripts(list_concat(a, b), 1) AS n FROM a)
SELECT k AS c_custkey, string_agg(v, ' ' ORDER BY n) AS joined FROM (SELECT k, i.value AS v, min(n) AS n FROM x GROUP BY k, i.scheme, i.value) GROUP BY k""")
def union_identifiers(spark, sf_dir):  # noqa: ANN001, ANN201
    def pair(*mods: int):  # noqa: ANN202
        return F.array(*[F.struct(F.lit("url").alias("scheme"), F.concat(F.lit("v"), (F.col("c_custkey") % m).cast("string")).alias("value")) for m in mods])

    joined = identifiers.union_identifiers(pair(7, 5), pair(3, 7))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(joined, lambda x: x["value"]), " ").alias("joined"))


ENTRY = "CASE c_custkey % 6 WHEN 0 THEN 'Fam' || c_custkey || ', Given' WHEN 1 THEN 'Anna B' || c_custkey || ' and Carl van D' || c_nationkey WHEN 2 THEN 'Fam' || c_custkey || ', A and Two, B and Three, C' WHEN 3 THEN 'Fam' || c_custkey || ', A and others' WHEN 4 THEN '{Body and ' || c_custkey || '}' ELSE '' END"


def entries(spark, sf_dir):  # noqa: ANN001, ANN202
    k, n, kind = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), F.col("c_custkey") % 6
    author = (
        F.when(kind == 0, F.concat(F.lit("Fam"), k, F.lit(", Given"))).when(kind == 1, F.concat(F.lit("Anna B"), k, F.lit(" and Carl van D"), n)).when(kind == 2, F.concat(F.lit("Fam"), k, F.lit(", A and Two, B and Three, C")))
        .when(kind == 3, F.concat(F.lit("Fam"), k, F.lit(", A and others"))).when(kind == 4, F.concat(F.lit("{Body and "), k, F.lit("}"))).otherwise("")
    )
    dated = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("c. "), F.col("c_nationkey") + 1900)).otherwise("")
    fields = F.create_map(F.lit("author"), author, F.lit("title"), F.concat(F.lit("The {Title} of the work "), k, F.lit(": a study")), F.lit("date"), dated, F.lit("publisher"), F.when(kind == 5, F.concat(F.lit("House"), n)).otherwise(""), F.lit("zz"), k)
    return table(spark, sf_dir, "customer").select("c_custkey", fields.alias("fields"))


@query(f"""WITH e AS (SELECT c_custkey, c_custkey % 6 AS kind, c_nationkey AS n, CASE WHEN c_nationkey % 2 = 0 THEN (1900 + c_nationkey)::VARCHAR ELSE '' END AS year FROM customer)
SELECT c_custkey, trim(CASE kind WHEN 0 THEN 'Fam' || c_custkey WHEN 1 THEN 'B' || c_custkey || ' and van D' || n WHEN 4 THEN 'Body and ' || c_custkey WHEN 5 THEN 'House' || n ELSE 'Fam' || c_custkey || ' et al.' END || ' ' || year) AS label, year FROM e""")
def citation_labels(spark, sf_dir):  # noqa: ANN001, ANN201
    return entries(spark, sf_dir).select("c_custkey", bibliography.citation_label(F.col("fields"), F.lit("key")).alias("label"), bibliography.citation_year(F.col("fields")).alias("year"))


@query(f"""SELECT c_custkey, CASE c_custkey % 6 WHEN 1 THEN 'B' || c_custkey || ', Anna and van D' || c_nationkey || ', Carl' WHEN 3 THEN {ENTRY} ELSE {ENTRY} END AS names FROM customer""")
def names_round_trip(spark, sf_dir):  # noqa: ANN001, ANN201
    return entries(spark, sf_dir).select("c_custkey", bibliography.serialize_names(bibliography.parse_names(F.col("fields")["author"])).alias("names"))


@query(f"""SELECT c_custkey, '@book{{k' || c_custkey || ',' || chr(10) || '  author = {{' || {ENTRY} || '}},' || chr(10) || '  title = {{The {{Title}} of the work ' || c_custkey || ': a study}},' || chr(10)
  || '  date = {{' || CASE WHEN c_nationkey % 2 = 0 THEN 'c. ' || (1900 + c_nationkey) ELSE '' END || '}},' || chr(10) || '  publisher = {{' || CASE WHEN c_custkey % 6 = 5 THEN 'House' || c_nationkey ELSE '' END || '}},' || chr(10) || '  zz = {{' || c_custkey || '}},' || chr(10) || '}}' AS entry FROM customer""")
def biblatexentries(spark, sf_dir):  # noqa: ANN001, ANN201
    return entries(spark, sf_dir).select("c_custkey", bibliography.serialized(F.lit("book"), F.concat(F.lit("k"), F.col("c_custkey").cast("string")), F.col("fields")).alias("entry"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'cf. ' ELSE '' END || 'W ' || o_orderkey || CASE WHEN o_custkey % 3 = 0 THEN ', ' || o_custkey ELSE '' END AS citation FROM orders""")
def citations(spark, sf_dir):  # noqa: ANN001, ANN201
    k = F.col("o_custkey")
    shown = bibliography.format_citation(F.concat(F.lit("W "), F.col("o_orderkey").cast("string")), F.when(k % 2 == 0, " cf. "), F.when(k % 3 == 0, k.cast("string")).otherwise("  "))
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("citation"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name ELSE '[' || p_name || '] x [y]' END AS bare FROM part""")
def unbracketed(spark, sf_dir):  # noqa: ANN001, ANN201
    m = F.col("p_partkey") % 3
    w = F.when(m == 0, F.concat(F.lit("["), "p_name", F.lit("]"))).when(m == 1, F.concat(F.lit("("), "p_name", F.lit(")"))).otherwise(F.concat(F.lit("["), "p_name", F.lit("] x [y]")))
    return table(spark, sf_dir, "part").select("p_partkey", fx.unbracketed(w).alias("bare"))


@query("""WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS r FROM s)
SELECT p_partkey, CASE WHEN r = 1 THEN slug ELSE slug || '-' || r END AS slug FROM n""")
def unique_slugs(spark, sf_dir):  # noqa: ANN001, ANN201
    from ..operators import registry

    return registry.unique_slugs(table(spark, sf_dir, "part").select("p_partkey", fx.slugify("p_name").alias("slug")), "slug", ["p_partkey"])
