"""Queries: normalisation rules and filters over short texts that are composed from the parts' columns."""

import re

from pyspark.sql import functions as F

from ..functions import rules as N, text as T, vectors as V
from ..operators import filters as O, tagger as G
from .base import Registry, planted, planted_sql, quoted

registry = Registry()
query = registry.add

#: Statements that are planted in the documents' texts, before or after what they hold.
PHRASES = [
    "Decaf, Swiss Water process, washed, medium roast", "decaffeinated by sugar cane", "sugar cane sweetness, honey process, light body",
    "Dark chocolate and cherry, Medium-Dark Roast", "natural process, light citrus | roast: light roast", "Mountain  Water decaf. Fully washed.",
    "French press classic; full body", "anaerobic natural, 1,950-2,050 masl", "giling basah (wet-hulled), italian roast",
    "디카페인 워시드 중배전", "semi washed, grown at 1600 m", "Blonde roast with light honey. Wet process.", "supercritical CO2 decaf, dry", "plain",
    "a 500 m run", "해발 1900미터", "1600~2000 masl, 900 m", "12,500 m away", "다크 초콜릿, 라이트 로스트",
]


def _picked(options: list[str]):
    return F.element_at(F.array(*[F.lit(x) for x in options]), (1 + F.col("p_partkey") % len(options)).cast("int"))


def _picked_sql(options: list[str], name: str) -> str:
    return f"x AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, [{quoted(options)}][1 + p_partkey % {len(options)}] AS {name} FROM part)"


def _ladder_sql(text: str, steps: list[tuple[str, str]], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN regexp_matches({text}, '{p}', 'i') THEN '{n}'" for n, p in steps)
    return f"CASE {whens} ELSE {default} END"


PHRASE_SQL = planted_sql(PHRASES)
_WORD_SQL = "regexp_matches(t, '(^|[^a-z])(decaf|decaffeinat)|디카페인', 'i')"
_DECAF_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(t, '{p}', 'i') AND ({alone} OR {_WORD_SQL}) THEN '{n}'" for n, p, alone in N.DECAF_PROCESSES
) + f" WHEN {_WORD_SQL} THEN 'unknown' END"


@query(f"WITH {PHRASE_SQL} SELECT doc_id, ({_DECAF_SQL}) IS NOT NULL AS decaf, {_DECAF_SQL} AS process FROM x")
def decaf_process(t):
    flag, process = N.decaf(F.col("t"))
    return planted(t, PHRASES).select("doc_id", flag.alias("decaf"), process.alias("process"))


@query(f"WITH {PHRASE_SQL} SELECT doc_id, {_ladder_sql('t', [(n, p) for n, p, _ in N.DECAF_PROCESSES] + [('swiss-water', 'water *process')])} AS method FROM x")
def decaf_method(t):
    return planted(t, PHRASES).select("doc_id", N.decaf_method(F.col("t")).alias("method"))


@query(f"WITH {PHRASE_SQL} SELECT doc_id, {_ladder_sql('t', N.LABEL_PROCESSES)} AS labelled, {_ladder_sql('t', N.PROSE_PROCESSES)} AS told FROM x")
def process_names(t):
    """A process as a label names it, and as prose does."""
    text = F.col("t")
    return planted(t, PHRASES).select("doc_id", N.ladder(text, N.LABEL_PROCESSES).alias("labelled"), N.ladder(text, N.PROSE_PROCESSES).alias("told"))


def _roast_sql(text: str) -> str:
    masked = f"regexp_replace({text}, '{N.NOT_A_ROAST}', ' ', 'gi')"
    phrases = f"array_to_string(regexp_extract_all({masked}, '({N.ROAST_PHRASE})', 1, 'i'), ' ; ')"
    return f"coalesce({_ladder_sql(phrases, N.ROASTS)}, {_ladder_sql(masked, N.ROASTS)})"


_SENTENCES = r"array_to_string(list_filter(regexp_split_to_array(t, '[\n.!?]+'), lambda s: regexp_matches(s, '{}', 'i')), ' ')".format(N.ROAST_WORDS)


@query(f"WITH {PHRASE_SQL}, y AS (SELECT *, {_SENTENCES} AS about FROM x) SELECT doc_id, {_roast_sql('t')} AS roast, {_roast_sql('about')} AS in_prose FROM y")
def roast_levels(t):
    """A roast level, flavours that share a roast word masked; and that of sentences about roasting alone."""
    text = F.col("t")
    return planted(t, PHRASES).select("doc_id", N.roast(text).alias("roast"), N.roast_in_prose(text).alias("in_prose"))


@query(f"""WITH {PHRASE_SQL}, y AS (SELECT doc_id, regexp_extract(t, '{N.ALTITUDE}', ['a', 'b'], 'i') AS m FROM x),
    n AS (SELECT doc_id, TRY_CAST(replace(nullif(m.a, ''), ',', '') AS DOUBLE) AS a, TRY_CAST(replace(nullif(m.b, ''), ',', '') AS DOUBLE) AS b FROM y)
    SELECT doc_id, CASE WHEN round_even((a + coalesce(b, a)) / 2, 0) BETWEEN 200 AND 3000 THEN CAST(round_even((a + coalesce(b, a)) / 2, 0) AS INT) END AS metres FROM n""")
def altitude_in_prose(t):
    return planted(t, PHRASES).select("doc_id", N.altitude_in_prose(F.col("t")).alias("metres"))


ORIGINS = [
    "Nyeri growing region, south-central Kenya", "United States (Hawaii)", "Tanzania, United Republic Of", "Sumatra, Indonesia", "에티오피아 예가체프",
    "Cote d?Ivoire", "romania and the javanese", "인도네시아산 원두", "인도 몬순", "somewhere", "Kenya; Colombia", "산지 콜롬비아, Brazil",
]
_COUNTRY_NAMES = {c.lower(): c for c in N.COUNTRIES} | N.COUNTRY_ALIASES
_COUNTRY_SQL = "[" + ", ".join("ROW('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in (_COUNTRY_NAMES | N.COUNTRIES_KO).items()) + "]"
_LATIN_SQL = "|".join(re.escape(k).replace("'", "''") for k in _COUNTRY_NAMES)


@query(rf"""WITH {planted_sql(ORIGINS)}, names AS (SELECT MAP_FROM_ENTRIES({_COUNTRY_SQL}) AS m),
    f AS (SELECT doc_id, regexp_extract(lower(t), '(?:^|[^a-z])({_LATIN_SQL})(?:$|[^a-z])|({"|".join(N.COUNTRIES_KO)})', ['latin', 'ko']) AS k FROM x)
    SELECT doc_id, map_extract_value(m, coalesce(nullif(k.latin, ''), k.ko)) AS country FROM f, names""")
def countries(t):
    """The country that a text names first: Latin names as whole words, Korean ones anywhere."""
    return planted(t, ORIGINS).select("doc_id", N.country(F.col("t")).alias("country"))


NAMES = ["커피_카페 라떼(HOT)", "비닐라 라떼 아이스(ICE)", "아메리카노 (Tall)", "카페 라떼 (K(코끼리))", "화이트 (Mini Venti)", "Mocha(ICED) (R)", "plain  latte ", "핫(HOT) 아포카토 (L)"]
_TEMP = N.TEMPERATURE


def _mended_sql(text: str) -> str:
    for slip, word in N.NAME_SLIPS.items():
        text = f"replace({text}, '{slip}', '{word}')"
    return text


@query(rf"""WITH {_picked_sql(NAMES, 'raw')}, a AS (SELECT p_partkey, regexp_replace(trim(raw), '^커피_', '') AS n FROM x),
    b AS (SELECT *, regexp_replace(n, '{_TEMP}', ' ', 'gi') AS bare, upper(regexp_extract(n, '({_TEMP})', 1, 'i')) AS mark FROM a),
    c AS (SELECT *, regexp_extract_all(bare, '\(([A-Za-z]{{1,10}})\)', 1)[-1] AS size FROM b),
    d AS (SELECT *, CASE WHEN size IS NOT NULL THEN regexp_replace(trim(bare), '\(' || size || '\)\s*$', '') ELSE bare END AS cut FROM c),
    e AS (SELECT *, {_mended_sql("trim(regexp_replace(cut, '\\s{2,}', ' ', 'g'))")} AS name FROM d)
    SELECT p_partkey, name, CASE WHEN mark LIKE '%HOT%' THEN 'HOT' WHEN mark <> '' THEN 'ICED' END AS temperature, size,
        trim(regexp_replace(trim(regexp_replace(name, '\s*\([A-Za-z]{{1,3}}\([^()]+\)\)\s*$', '')), '\s*\((?:{N.SIZE_WORDS})(?:\s+(?:{N.SIZE_WORDS}))*\)\s*$', '', 'i')) AS plain FROM e""")
def drink_names(t):
    """Names without prefix, temperature, size and branch marks."""
    name, temperature, size = N.drink_name(_picked(NAMES))
    rows = t("part").select("p_partkey", name.alias("name"), temperature.alias("temperature"), size.alias("size"))
    return rows.withColumn("plain", N.without_sizes(N.without_branch(F.col("name"))))


@query("""SELECT p_partkey, p_name LIKE '%hot%' OR coalesce(mg <= 15, false) AS decaf, p_name NOT LIKE '%bolt%' AND p_type IN ('PROMO', 'LARGE') AND NOT (p_name LIKE '%hot%' OR coalesce(mg <= 15, false)) AS option
    FROM (SELECT *, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS mg FROM part)""")
def menu_flags(t):
    """Decaf by name or trace amount, and whether it can be ordered."""
    mg = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size"))
    listed = F.col("p_type").isin("PROMO", "LARGE")
    decaf, option = O.item_flags(F.col("p_name").contains("hot"), mg, ~F.col("p_name").contains("bolt"), listed)
    return t("part").select("p_partkey", decaf.alias("decaf"), option.alias("option"))


@query("""SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND NOT regexp_matches(p_name, 'anvil|gizmo(.*x)?')""")
def row_class(t):
    """Rows of one class whose name is no combination."""
    return t("part").where((F.col("p_type") == "PROMO") & ~N.has(F.col("p_name"), "anvil|gizmo(?!.*ring)")).select("p_partkey")


@query("""SELECT p_partkey FROM part WHERE NOT regexp_matches(p_name, '\\b(anvil|old|cold)\\b', 'i')""".replace("\\\\", "\\"))
def excluded_names(t):
    return t("part").where(~N.has(F.col("p_name"), r"\b(?:anvil|old|cold)\b")).select("p_partkey")


@query("""WITH p AS (SELECT p_partkey, p_brand, p_type, p_name, [split_part(p_name, ' ', 1), p_brand] AS tags FROM part)
    SELECT p_partkey FROM p WHERE NOT regexp_matches(p_name, '\\b(anvil|rod)\\b') AND CASE p_brand WHEN 'Brand#1' THEN p_type IN ('PROMO', 'SMALL') WHEN 'Brand#2' THEN regexp_matches(p_type, '^S')
        WHEN 'Brand#3' THEN list_contains(tags, 'red') WHEN 'Brand#4' THEN NOT list_has_any(tags, ['hot', 'old']) ELSE true END""".replace("\\\\", "\\"))
def product_class(t):
    """Products by their store's config: types, a type pattern, required and excluded tags; some titles never."""
    spark = t("part").sparkSession
    config = spark.createDataFrame(
        [("Brand#1", ["PROMO", "SMALL"], None, None, None), ("Brand#2", None, "^S", None, None), ("Brand#3", None, None, "RED", None), ("Brand#4", None, None, None, ["Hot", "OLD"])],
        "store string, types array<string>, type_pattern string, require_tag string, exclude_tags array<string>",
    )
    rows = t("part").select(
        "p_partkey", F.col("p_brand").alias("store"), F.col("p_type").alias("type"), F.col("p_name").alias("title"),
        F.array(F.element_at(F.split("p_name", " "), 1), F.col("p_brand")).alias("tags"),
    )
    return O.product_filter(rows, config, "store", r"\b(?:anvil|rod)\b").select("p_partkey")


@query("""SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source NOT IN ('src1', 'src2') AND n_chars IS NOT NULL AND doc_id % 3 <> 0""")
def wanted_rows(t):
    """Rows of some languages and not of some sources, with a length and at least one tag."""
    tags = F.when(F.col("doc_id") % 3 != 0, F.array("lang"))
    rows = O.wanted_rows(t("documents").withColumn("tags", tags), only=["en", "fr"], source="lang", present=["n_chars"], tagged="tags")
    return O.wanted_rows(rows, without=["src1", "src2"]).select("doc_id")


@query("""SELECT o.event_id, p.p_partkey, p.p_name, p.p_partkey % 4 <> 0 AND NOT p.p_partkey % 9 = 0 AS shown FROM events o JOIN part p ON p.p_partkey = o.event_id % 500""")
def retired_rows(t):
    """Browsing shows active, reviewed rows; events still find retired ones by id."""
    rows = t("part").select("p_partkey", "p_name", (F.col("p_partkey") % 4 != 0).alias("active"), (F.col("p_partkey") % 9 == 0).alias("review"))
    shown = O.served(rows, "active", "review").select("p_partkey").withColumn("shown", F.lit(True))
    found = t("events").select("event_id", (F.col("event_id") % 500).alias("p_partkey")).join(rows, "p_partkey").join(shown, "p_partkey", "left")
    return found.select("event_id", "p_partkey", "p_name", F.coalesce("shown", F.lit(False)).alias("shown"))


@query("""WITH q AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '  HOT   Ring ' WHEN 1 THEN 'Brand#' || (c_custkey % 30) || ' red Bolt' ELSE 'no such' END AS t FROM customer),
    n AS (SELECT lower(p_name) AS n, p_partkey FROM part UNION ALL SELECT lower(p_brand || ' ' || p_name), p_partkey FROM part)
    SELECT c_custkey, min(p_partkey) AS p_partkey FROM q JOIN n ON n.n = lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) GROUP BY c_custkey""".replace("\\\\", "\\"))
def exact_names(t):
    """The first item of the name, or of the group and name, that is asked for."""
    k = F.col("c_custkey")
    asked = F.when(k % 3 == 0, "  HOT   Ring ").when(k % 3 == 1, F.concat(F.lit("Brand#"), (k % 30).cast("string"), F.lit(" red Bolt"))).otherwise("no such")
    return O.exact_name_match(t("customer").select("c_custkey", asked.alias("t")), "t", "c_custkey", t("part"), "p_partkey", "p_name", "p_brand")


@query("""SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN p_size + 100 ELSE p_size END AS body, CASE WHEN p_type = 'SMALL' THEN 'open' ELSE 'full' END AS variant FROM part""")
def variant_columns(t):
    """One column or another under one name, by variant."""
    open_ = F.col("p_type") == "SMALL"
    body = O.struct_or_else(open_, F.struct(F.col("p_size").alias("v")), F.struct((F.col("p_size") + 100).alias("v")))["v"]
    return t("part").select("p_partkey", body.alias("body"), O.struct_or_else(open_, F.lit("full"), F.lit("open")).alias("variant"))


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'x' END AS cue, CASE WHEN p_partkey % 3 = 0 THEN ['n'] ELSE [] END AS notes, CASE WHEN p_partkey % 2 = 0 THEN 'o' END AS origin FROM part)
    SELECT p_partkey, CASE WHEN cue IS NOT NULL THEN 'cue' WHEN len(notes) > 0 THEN 'notes' WHEN origin IS NOT NULL THEN 'facts' ELSE 'sparse' END AS bucket FROM x""")
def support_buckets(t):
    return t("part").select("p_partkey", _bucket().alias("bucket"))


def _bucket():
    k = F.col("p_partkey")
    notes = F.when(k % 3 == 0, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>"))
    return O.support_bucket(F.when(k % 5 == 0, "x"), notes, [F.when(k % 2 == 0, "o")])


@query("""WITH x AS (SELECT p_brand || '/' || p_type AS item, 'a' || (p_partkey % 2) AS attr, CASE WHEN p_partkey % 4 <> 0 THEN 1 END AS v,
        CASE WHEN p_partkey % 5 = 0 THEN 'cue' WHEN p_partkey % 3 = 0 THEN 'notes' WHEN p_partkey % 2 = 0 THEN 'facts' ELSE 'sparse' END AS bucket FROM part WHERE p_size < 10),
    l AS (SELECT item, CASE WHEN bucket = 'cue' THEN 3 WHEN attr = 'a0' AND bucket = 'notes' THEN 3 WHEN attr = 'a0' AND bucket = 'facts' THEN 2 WHEN attr = 'a1' THEN 2 ELSE 1 END AS o FROM x WHERE v IS NOT NULL)
    SELECT DISTINCT x.item, ['low', 'medium', 'high'][coalesce((SELECT min(o) FROM l WHERE l.item = x.item), 1)] AS confidence FROM x""")
def calibrated_confidence(t):
    """The lowest level of an item's attributes, each by what it rests on."""
    k = F.col("p_partkey")
    rows = t("part").where("p_size < 10").select(
        F.concat_ws("/", "p_brand", "p_type").alias("item"), F.concat(F.lit("a"), (k % 2).cast("string")).alias("attr"), F.when(k % 4 != 0, 1).alias("v"), _bucket().alias("bucket")
    )
    levels = rows.sparkSession.createDataFrame([("a0", "notes", "high"), ("a0", "facts", "medium"), ("a1", "*", "medium")], "attr string, bucket string, level string")
    return O.calibrated_confidence(rows, "item", "attr", "v", "bucket", levels)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'source' WHEN p_partkey % 7 = 0 THEN 'none' WHEN p_partkey % 3 = 0 THEN 'rule' WHEN p_partkey % 2 = 0 THEN 'model' ELSE 'unknown' END AS origin FROM part""")
def value_origins(t):
    k = F.col("p_partkey")
    origin = O.value_origin(F.when(k % 5 == 0, 1), F.when(k % 7 != 0, 1), k % 3 == 0, k % 2 == 0)
    return t("part").select("p_partkey", origin.alias("origin"))


NOTES = ["딸기, 자스민 · 라임", "lemon, brown sugar, plum.", "a long tagline that is no list, plum", "", "콜롬비아 Colombia, x", "one·two·three·four·five·six·seven·eight·nine"]


@query(f"""WITH {_picked_sql(NOTES, 't')}, s AS (SELECT p_partkey, t, list_filter(list_transform(regexp_split_to_array(t, '[,·ㆍ]'), lambda p: trim(p, ' .')), lambda p: p <> '') AS w,
        nullif(regexp_extract(trim(t), '^([가-힣][가-힣,\\s]*)', 1), '') AS run FROM x)
    SELECT p_partkey, array_to_string(CASE WHEN list_bool_or(list_transform(w, lambda p: length(p) > 16)) THEN [] ELSE w[1:8] END, '|') AS notes,
        CASE WHEN run IS NOT NULL THEN trim(run, ' ,') ELSE trim(t) END AS lead FROM s""".replace("\\\\", "\\"))
def note_lists(t):
    """The words of a notes field, unless it is prose; and what leads it in one script."""
    text = _picked(NOTES)
    return t("part").select("p_partkey", F.array_join(N.note_list(text), "|").alias("notes"), N.leading_script(text).alias("lead"))


CARDS = [
    "Altitude: 1800 m\nVariety: Bourbon\nTasting Notes: Apple Pie, Hibiscus and Lemon", "origin: Kenya\nprocess: washed\nregion: Nyeri",
    "Expect notes of Yellow Plum, Almond. More.", "Roast level: dark\nelevation: 1,200\nAltitude: 900", "no facts here",
    "Processing method\n  Natural\nCountry Peru\norigin: Java", "Varietal\n: Gesha\nOriginally from Kenya",
]
_FACTS_SQL = N.FACT_LINE.replace("(?imd)", "(?im)").format(words="|".join(sorted(N.FACT_LABELS, key=lambda w: (-len(w), w))))
_NOTES_SQL = r"(?is)(?:(?:tasting|cupping|flavou?r|cup)\s+notes?\s*:?\s*|notes\s+of\s+)([^\n.]{3,120})"


@query(rf"""WITH {planted_sql(CARDS)}, l AS (SELECT doc_id, t, regexp_extract_all(t, '{_FACTS_SQL}', 1) AS k, regexp_extract_all(t, '{_FACTS_SQL}', 2) AS v FROM x),
    e AS (SELECT doc_id, unnest(list_transform(k, lambda w: map_extract_value(MAP {N.FACT_LABELS}, lower(w)))) AS k, unnest(v) AS v, unnest(range(len(k))) AS i FROM l),
    f AS (SELECT doc_id, string_agg(f, ';' ORDER BY f) AS facts FROM (SELECT doc_id, k || '=' || trim(arg_min(v, i)) AS f FROM e GROUP BY doc_id, k) GROUP BY 1),
    n AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(replace(replace(regexp_extract(t, '{_NOTES_SQL}', 1), '|', ', '), ' and ', ', '), '&', ', '), '[,;/]'), lambda w: trim(w, ' .;:-')),
        lambda w: w <> '' AND length(w) <= 30)[1:8] AS w FROM x)
    SELECT doc_id, coalesce(facts, '') AS facts, array_to_string(w, '|') AS notes FROM n LEFT JOIN f USING (doc_id)""")
def labelled_lines(t):
    """Facts on labelled lines, of repeated ones the first, and note words."""
    text = F.col("t")
    facts = F.array_sort(F.transform(F.map_entries(N.labelled_facts(text)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return planted(t, CARDS).select("doc_id", F.array_join(facts, ";").alias("facts"), F.array_join(N.note_words(text), "|").alias("notes"))


@query("""SELECT p_partkey, round_even(least(5.0, greatest(1.0, round_even(p_size / 7.0 * 2, 0) / 2)), 1) AS half, CASE WHEN p_size * 3 <= 100 THEN round_even((1 + 4 * (p_size * 3) / 100.0) * 2, 0) / 2 END AS gauge,
    p_type <> 'SMALL' AND upper(p_type) <> 'G' AS mixed, p_size AS whole, CASE WHEN p_size > 10 THEN p_name || chr(10) || p_brand ELSE p_brand END AS joined FROM part""")
def small_scalars(t):
    s = F.col("p_size").cast("double")
    other = F.when(F.col("p_type") == "SMALL", F.lit(None).cast("string")).otherwise(F.lit(" g "))
    return t("part").select(
        "p_partkey", N.half_step(s / 7).alias("half"), N.gauge_from_percent(s * 3).alias("gauge"), N.unit_mismatch(F.col("p_type"), other).alias("mixed"),
        N.whole_number(s + 0.75).cast("int").alias("whole"), N.join_text(F.when(s > 10, F.col("p_name")).otherwise(" "), F.col("p_brand")).alias("joined"),
    )


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'base ' || p_type ELSE 'extra' END AS name, true AS found FROM part""")
def merged_names(t):
    """Names of two maps; the base map's name stays where both have one."""
    base = F.when(F.col("p_partkey") % 3 != 0, F.create_map(F.col("p_type"), F.concat(F.lit("base "), "p_type"))).otherwise(F.create_map(F.lit("none"), F.lit("x")))
    both = V.merged_maps(base, F.create_map(F.col("p_type"), F.lit("extra")))
    return t("part").select("p_partkey", F.try_element_at(both, F.col("p_type")).alias("name"), F.map_contains_key(both, F.col("p_type")).alias("found"))


@query("""SELECT 'item:fruity>' || split_part(p_name, ' ', 1) || '>' || split_part(p_name, ' ', 2) AS path, split_part(p_name, ' ', 2) AS tag, 'fruity>' || split_part(p_name, ' ', 1) AS head FROM part GROUP BY p_name""")
def path_heads(t):
    """The first two parts of each tag's path."""
    words = F.split("p_name", " ")
    paths = t("part").select(F.concat(F.lit("item:fruity>"), words[0], F.lit(">"), words[1]).alias("path"), words[1].alias("tag")).distinct()
    return paths.select("path", "tag", N.path_head(F.col("path"), "item:").alias("head"))


@query("""WITH p AS (SELECT split_part(p_name, ' ', 2) AS tag, split_part(p_name, ' ', 1) AS parent, min(p_partkey) AS pos FROM part GROUP BY 1, 2) SELECT tag, arg_min('fruity>' || parent, pos) AS head FROM p GROUP BY tag""")
def tag_paths(t):
    """Each tag's path at the second level: the first listed where a tag has several."""
    words = F.split("p_name", " ")
    rows = t("part").select(F.concat(F.lit("item:fruity>"), words[0], F.lit(">"), words[1]).alias("path"), F.lit(3).alias("level"), words[1].alias("name"), F.col("p_partkey").alias("pos"))
    return G.tag_paths(rows, "item:").select("tag", "head")
