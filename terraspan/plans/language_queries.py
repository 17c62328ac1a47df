"""Queries over plain-language text; conversations and a literal list stand
for what users ask."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraspan.functions import language as lang
from terraspan.plans._base import query, table

#: Questions that exercise every rule.
QUESTIONS = [
    "Find newly built structures near rivers between 2022 and 2024", "structures near rivers", "Show SAR imagery of ports in 2023",
    "compare optical and sar over Mumbai", "sentinel-2 vegetation along coast from 2019 to 2021", "What is visible in this image?",
    "Is vegetation present?", "What changed between these observations?", "Compute NDVI for the field", "Give the exact coordinates",
    "What is the exact area in hectares?", "Why did the forest disappear? deforestation", "What is the EPSG and resolution?",
    "Find similar sites to this one", "Did construction occur here?", "Could this be seasonal?", "Show the review queue",
    "locate the bridge within the delta using radar", "How many ships are in the harbor?", "flood inundation in Assam during 2020",
    "liss imagery of Gujarat", "cartosat city images", "count vessels", "describe the scene", "", "   ", "the a an of",
    "expansion around lake from 2015 to 2016", "cyclone rainfall over arabian sea", "tell me more about before and after",
]
#: The words that have to be known, stated here once more, so that
#: the SQL doesn't lean on the engine's tables.
OBJECTS = [
    ("build|structure|building", "built structures"), ("road|highway|street", "road network"), ("port|harbor|dock|pier|quay", "port infrastructure"), ("vessel|ship|boat", "maritime vessels"),
    ("bridge", "bridge"), ("dam|reservoir", "reservoir / dam"), ("crop|farmland|field", "agricultural parcels"),
]
ACTIONS = [
    ("newly built|new construction|construction|building", "new construction"), ("expansion|expanding|growth|growing", "expansion"), ("clearance|clearing|cleared", "clearing"),
    ("deforestation|tree loss", "deforestation"), ("flood|inundation|water spread", "inundation"),
]
ENVIRONMENT = [
    ("river|stream", "river"), ("water|lake|basin", "water body"), ("coast|coastal|shore", "coastal zone"), ("forest|vegetation|green", "vegetation / forest"), ("delta", "delta"),
    ("urban|city|suburb", "urban zone"),
]
SATELLITES = [
    (["sentinel-2", "sentinel 2", "s2"], "SENTINEL-2", "MSI", "optical"), (["sentinel-1", "sentinel 1", "s1"], "SENTINEL-1", "C-SAR", "sar"),
    (["resourcesat", "rs2", "liss"], "RESOURCESAT-2A", "LISS-3", "multispectral"), (["cartosat", "carto"], "CARTOSAT-2", "PAN-MX", "optical"),
    (["sar", "radar", "backscatter"], None, None, "sar"), (["multispectral", "ndvi", "nir"], None, None, "multispectral"), (["optical"], None, None, "optical"),
]
PLACES = "mumbai ahmedabad gujarat visakhapatnam godavari assam brahmaputra sundarbans bengaluru chennai delhi".split()
STOP_WORDS = "find show search locate detect images imagery scenes where that with using between and from to in of the a an".split()
TEMPORAL_WORDS = "change|expand|growth|newly|before|after|earliest|over time|transition"
MULTIMODAL_WORDS = "multimodal|optical.*sar|sar.*optical|cross-modal|both optical and sar"
INTENT_WORDS = {
    "METADATA": ["metadata", "pixel dimension", "dimensions and bands", "band count", "resolution", "epsg", "crs", "raster header", "file size"],
    "GEO_COORDINATES": ["latitude", "longitude", "exact coordinates", "gps coordinate", "lat/long", "exact location"],
    "QUANTITATIVE_MEASUREMENT": [
        "exact area", "square meter", "sq meter", "square kilometer", "sq km", "hectare", "acre", "exact measurement", "exact distance", "sub-pixel", "water depth in meters", "salinity percentage",
    ],
    "SPECTRAL_INDEX": ["ndvi", "ndwi", "evi", "savi", "vegetation index", "water index"],
    "CAUSAL_ATTRIBUTION": [
        "why did", "what caused", "cause of", "caused by", "attributed to", "attribution", "did construction occur", "was it construction", "deforestation", "deforested", "flood damage",
        "disaster damage", "crop type", "specific crop", "cleared for agriculture",
    ],
}
CHANGE_WORDS = [
    "change", "difference between", "expand", "increase", "decrease", "shrink", "temporal", "before and after", "between these observations", "between these dates", "over time",
]
VISIBLE_WORDS = [
    "what is visible", "is vegetation present", "is water visible", "is water present", "are buildings visible", "visible colors", "visible features", "colors and patterns", "shapes and geometric",
    "textures and light", "visible in this image", "visible in these images", "visible patterns", "visible textures", "what do you see", "what is seen",
]
VISIBLE_STARTS = ["what is visible", "describe the visible", "describe what is visible", "describe visible"]
LOOK_WORDS = ["visible", "color", "pattern", "texture", "shape", "feature", "vegetation", "appearance", "describe", "look like"]
#: Every word in a question of its own, so that each rule is met.
QUESTIONS += [f"about {w}" for words in (OBJECTS, ACTIONS, ENVIRONMENT) for pattern, _ in words for w in pattern.split("|")]
QUESTIONS += [f"of {w}" for words in (*(x[0] for x in SATELLITES), PLACES, *INTENT_WORDS.values(), CHANGE_WORDS, VISIBLE_WORDS, LOOK_WORDS) for w in words]
QUESTIONS += [*VISIBLE_STARTS, *(f"{w} it" for w in TEMPORAL_WORDS.split("|")), "multimodal", "optical then sar", "sar, optical", "cross-modal", "both optical and sar"]
VALUES = ", ".join("(" + str(k) + ", '" + q.replace("'", "''") + "')" for k, q in enumerate(QUESTIONS))
ALL_SQL = f"q AS (SELECT id, q AS raw, lower(trim(q)) AS q FROM (SELECT * FROM (VALUES {VALUES}) v(id, q) UNION ALL SELECT 1000000 + conv_id * 1000 + turn, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) FROM conversations))"


def _questions(spark, sf):
    own = spark.createDataFrame(list(enumerate(QUESTIONS)), "id long, query string")
    said = table(spark, sf, "conversations").select((F.lit(1000000) + F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("id"), F.col("text").alias("query"))
    return own.unionByName(said)


def any_of(words: list[str]) -> str:
    return "(" + " OR ".join("contains(q, '" + w.replace("'", "''") + "')" for w in words) + ")"


def tags(pairs: list[tuple[str, str]]) -> str:
    inner = ", ".join(f"CASE WHEN regexp_matches(q, '{p}') THEN '{x}' END" for p, x in pairs)
    return f"array_to_string([x FOR x IN [{inner}] IF x IS NOT NULL], '|')"


TAG_SQL = f"""WITH {ALL_SQL} SELECT id, {tags(OBJECTS)} AS objects, {tags(ACTIONS)} AS actions, {tags(ENVIRONMENT)} AS environment FROM q"""


@query(TAG_SQL)
def str_concept_tags(spark, sf):
    p = lang.with_plan(_questions(spark, sf), only=["objects", "actions", "environment"])
    return p.select("id", *[F.array_join(f"plan.{c}", "|").alias(c) for c in ("objects", "actions", "environment")])


DATES = """CASE WHEN regexp_matches(q, 'between\\s+\\d{4}(-\\d{2})?\\s+and\\s+\\d{4}') THEN {b}
 WHEN regexp_matches(q, 'from\\s+\\d{4}\\s+to\\s+\\d{4}') THEN {f} WHEN regexp_matches(q, '(in|during|for)\\s+20\\d{2}') THEN {s} END"""


def _dates(group: int, tail: str) -> str:
    pick = "regexp_extract(q, '{}', {})"
    b = pick.format(r"between\s+(\d{4})(?:-\d{2})?\s+and\s+(\d{4})", group)
    f = pick.format(r"from\s+(\d{4})\s+to\s+(\d{4})", group)
    s = pick.format(r"(?:in|during|for)\s+(20\d{2})", 1)
    return "(" + DATES.replace("{b}", b).replace("{f}", f).replace("{s}", s) + f") || '{tail}'"


@query(f"WITH {ALL_SQL} SELECT id, {_dates(1, '-01-01')} AS start_date, {_dates(2, '-12-31')} AS end_date FROM q")
def str_date_range(spark, sf):
    p = lang.with_plan(_questions(spark, sf), only=["date_range"])
    return p.select("id", F.col("plan.date_range.start").alias("start_date"), F.col("plan.date_range.end").alias("end_date"))


def _case(rows, k: int) -> str:
    out = "CASE"
    for words, *rest in rows:
        out += f" WHEN {any_of(words)} THEN " + ("NULL" if rest[k] is None else f"'{rest[k]}'")
    return out + " END"


@query(f"WITH {ALL_SQL} SELECT id, {_case(SATELLITES, 0)} AS satellite, {_case(SATELLITES, 1)} AS sensor, {_case(SATELLITES, 2)} AS modality FROM q")
def str_sensor_cascade(spark, sf):
    p = lang.with_plan(_questions(spark, sf), only=["satellite", "sensor", "modality"])
    return p.select("id", "plan.satellite", "plan.sensor", "plan.modality")


#: The pattern of the engine, with the end of the feature matched instead of looked at.
REL = r"(near|along|around|close to|adjacent to|within)\s+([a-z\s]+?)(\s+(between|from|in|using|with|during)\b|\s*$)"


@query(f"""WITH {ALL_SQL} SELECT id, nullif(trim(regexp_extract(q, '{REL}', 1)), '') AS relation, CASE WHEN regexp_matches(q, '{REL}') THEN trim(regexp_extract(q, '{REL}', 2)) END AS feature FROM q""")
def str_spatial_relation(spark, sf):
    p = lang.with_plan(_questions(spark, sf), only=["spatial_relation"])
    return p.select("id", F.col("plan.spatial_relation.relation").alias("relation"), F.col("plan.spatial_relation.feature").alias("feature"))


STOPS = r"\b(" + "|".join(STOP_WORDS) + r")\b"


@query(f"""WITH {ALL_SQL}, t AS (SELECT id, q, array_to_string([x FOR x IN [{tags(ACTIONS)}, {tags(OBJECTS)}, {tags(ENVIRONMENT)}] IF x <> ''], '|') AS tags FROM q)
SELECT id, CASE WHEN tags <> '' THEN replace(tags, '|', ' ') ELSE trim(regexp_replace(regexp_replace(q, '{STOPS}', ' ', 'g'), '\\s+', ' ', 'g')) END AS semantic_query FROM t""")
def str_semantic_query(spark, sf):
    return lang.with_plan(_questions(spark, sf), only=["semantic_query"]).select("id", "plan.semantic_query")


@query(f"WITH {ALL_SQL} SELECT id, CASE " + " ".join(f"WHEN contains(q, '{p}') THEN '{p.title()}'" for p in PLACES) + " END AS aoi_hint FROM q")
def str_aoi_hint(spark, sf):
    return lang.with_plan(_questions(spark, sf), only=["aoi_hint"]).select("id", "plan.aoi_hint")


TEMPORAL = "(" + _dates(1, "") + f") IS NOT NULL OR regexp_matches(q, 'newly built|new construction|construction|building|expansion|expanding|growth|growing|clearance|clearing|cleared|deforestation|tree loss|flood|inundation|water spread') OR regexp_matches(q, '{TEMPORAL_WORDS}')"


@query(f"""WITH {ALL_SQL}, k AS (SELECT id, q, {_case(SATELLITES, 1)} AS sensor, {_case(SATELLITES, 2)} AS modality, {tags(OBJECTS)} AS objects FROM q)
SELECT id, CASE WHEN q = '' THEN 'GENERAL_SEMANTIC' WHEN regexp_matches(q, '{MULTIMODAL_WORDS}') THEN 'MULTIMODAL_SEARCH'
 WHEN {TEMPORAL} THEN 'TEMPORAL_CHANGE_DISCOVERY'
 WHEN modality = 'sar' OR regexp_matches(q, 'sar|radar|microwave|backscatter') OR sensor IS NOT NULL THEN 'SENSOR_CONSTRAINED_SEARCH'
 WHEN regexp_matches(q, '{REL}') THEN 'RELATIONAL_SEARCH'
 WHEN objects <> '' THEN 'OBJECT_SCENE_SEARCH' ELSE 'GENERAL_SEMANTIC' END AS intent FROM k""")
def str_search_intent(spark, sf):
    return lang.with_plan(_questions(spark, sf), only=["intent"]).select("id", "plan.intent")


CHANGE, SEEN = any_of(CHANGE_WORDS), "(" + any_of(VISIBLE_WORDS) + " OR " + " OR ".join(f"starts_with(q, '{w}')" for w in VISIBLE_STARTS) + ")"
INTENT_SQL = "CASE " + " ".join(f"WHEN {any_of(w)} THEN '{n}'" for n, w in INTENT_WORDS.items()) + f""" WHEN {SEEN} AND NOT {CHANGE} THEN 'VISUAL_OBSERVATION'
 WHEN {CHANGE} THEN 'TEMPORAL_CHANGE' WHEN {SEEN} OR {any_of(LOOK_WORDS)} THEN 'VISUAL_OBSERVATION' ELSE 'GENERAL' END"""


@query(f"WITH {ALL_SQL} SELECT id, {INTENT_SQL} AS intent FROM q")
def str_question_intent(spark, sf):
    return _questions(spark, sf).select("id", lang.question_intent(F.col("query")).alias("intent"))


#: Setups of images: (setup, task, images, optical, radar, before and after, session).
SETUPS = [
    ("one optical", "SCENE_INTERPRETATION", 1, 1, 0, False, False), ("one radar", "SAR_ANALYSIS", 1, 0, 1, False, False),
    ("one of neither", "SCENE_INTERPRETATION", 1, 0, 0, False, True), ("two optical", "SCENE_INTERPRETATION", 2, 2, 0, False, False),
    ("two dates", "BI_TEMPORAL_ANALYSIS", 2, 2, 0, True, True), ("optical and radar", "OPTICAL_SAR_ANALYSIS", 2, 1, 1, False, False),
    ("mixed dates", "CHANGE_VQA", 2, 1, 1, True, False), ("none", "SCENE_INTERPRETATION", 0, 0, 0, False, False),
    ("none, asked before", "FOLLOW_UP", 0, 0, 0, False, True), ("three", "CHANGE_VQA", 3, 2, 1, True, False),
]
SETUP_SQL = ALL_SQL + ", u AS (SELECT * FROM q, (VALUES " + ", ".join(str(x) for x in SETUPS) + ") v(setup, task, n, opt, rad, ba, ses))"


def _set_up(spark, sf):
    """Every question in every setup."""
    names = ["setup", "task", "n", "opt", "rad", "ba", "ses"]
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, x, strict=True)]) for x in SETUPS])
    return _questions(spark, sf).select("*", F.inline(each))


#: The rules once more, word by word, so that a wrong word in the engine shows.
TASK_SQL = """CASE
 WHEN regexp_matches(q, 'similar to this|find more like this|similar site|similar locations|comparable sites|locations similar|cluster similar|more like this|find similar') THEN 'SIMILAR_SITE_DISCOVERY'
 WHEN regexp_matches(q, '^(find |search |retrieve )|find (areas|scenes|newly|locations|structures|vehicles)|search archive|search for scenes|show scenes showing|locate scenes|retrieve imagery') THEN 'SEMANTIC_RETRIEVAL'
 WHEN regexp_matches(q, 'acquisition date|sensor and source|(show|inspect|acquisition) metadata|what (sensor|satellite)|provenance|epsg|crs|resolution|pixel dimension|dimensions and bands') THEN 'METADATA_PROVENANCE'
 WHEN regexp_matches(q, 'seasonal|false alarm|illumination|sun angle|shadow artifact|sensor artifact|misregistration|registration error|cloud shadow|haze|radiometric') THEN 'FALSE_ALARM_ASSESSMENT'
 WHEN regexp_matches(q, 'did (construction|building|structure) appear|did (construction|change) occur|(verify|confirm) change|assess possible construction|assess water extent change|did it appear between|did expansion happen') THEN 'CHANGE_VERIFICATION'
 WHEN regexp_matches(q, 'what changed|difference between|compare observations|before and after|temporal change|review change evidence|what differs|between these (observations|dates)') THEN 'MULTITEMPORAL_CHANGE'
 WHEN regexp_matches(q, 'analyst review|review queue|audit status|mark (confirmed|rejected)') THEN 'ANALYST_REVIEW'
 WHEN n = 2 AND opt > 0 AND rad > 0 AND regexp_matches(q, 'sar|optical|radar|cross-modal|complementary|compare') THEN 'OPTICAL_SAR_ANALYSIS'
 WHEN NOT (n = 2 AND opt > 0 AND rad > 0) AND (regexp_matches(q, 'sar | sar|radar') OR (n = 1 AND rad = 1)) THEN 'SAR_ANALYSIS'
 WHEN n = 0 AND ses THEN 'FOLLOW_UP' WHEN n = 0 AND contains(q, 'show scenes') THEN 'SEMANTIC_RETRIEVAL' WHEN n = 0 THEN 'UNSUPPORTED_QUERY'
 WHEN ses AND regexp_matches(q, 'what did you mean|why|expand on|tell me more|previous') THEN 'FOLLOW_UP'
 WHEN n = 2 AND intent = 'VISUAL_OBSERVATION' AND regexp_matches(q, 'describe|what is happening|caption|what is visible') THEN 'SCENE_DESCRIPTION'
 WHEN n = 2 AND intent = 'VISUAL_OBSERVATION' AND opt > 0 AND rad > 0 THEN 'OPTICAL_SAR_ANALYSIS'
 WHEN n = 2 AND intent = 'VISUAL_OBSERVATION' THEN 'SINGLE_IMAGE_VQA'
 WHEN n = 2 AND (ba OR regexp_matches(q, 'change|difference|temporal|expand')) THEN 'BI_TEMPORAL_ANALYSIS'
 WHEN n = 2 AND opt > 0 AND rad > 0 THEN 'OPTICAL_SAR_ANALYSIS' WHEN n = 2 THEN 'BI_TEMPORAL_ANALYSIS'
 WHEN regexp_matches(q, 'count|how many') THEN 'COUNTING' WHEN regexp_matches(q, 'where is|locate|ground|bbox') THEN 'TEXT_GUIDED_GROUNDING'
 ELSE 'SCENE_INTERPRETATION' END"""


@query(f"WITH {SETUP_SQL}, k AS (SELECT *, {INTENT_SQL} AS intent FROM u) SELECT id, setup, {TASK_SQL} AS task_class FROM k")
def str_task_class(spark, sf):
    task = lang.task_class(F.col("query"), F.col("n"), F.col("opt"), F.col("rad"), F.col("ba"), F.col("ses"))
    return _set_up(spark, sf).select("id", "setup", task.alias("task_class"))


PLAN_SQL = """SELECT id, setup, array_to_string(list_concat(
  CASE WHEN facts THEN ['Dimensions', 'BandCount', 'GeospatialCRS'] ELSE [] END,
  CASE WHEN plants THEN ['NDVI', 'ExcessGreenProxy', 'VegetationCandidateRegions'] ELSE [] END,
  CASE WHEN water THEN ['WaterLowReflectanceThreshold', 'SpecularRadarBackscatter'] ELSE [] END,
  CASE WHEN change THEN ['TemporalRegistration', 'MeanAbsoluteDifference', 'ConfounderScreening'] ELSE [] END,
  CASE WHEN radar THEN ['SARBackscatterMoments', 'SpeckleENL', 'PolarizationCheck'] ELSE [] END,
  CASE WHEN mixed THEN ['CommonSpatialGridAlignment', 'CrossSensorAgreementCheck'] ELSE [] END), '|') AS measurements,
 'validateRaster|inspectBands' || CASE WHEN plants THEN '|computeSpectralIndex|analyzeOpticalEvidence' ELSE '' END
  || CASE WHEN water THEN '|analyzeOpticalEvidence|computeSpectralIndex' ELSE '' END || CASE WHEN change THEN '|registerTemporalImages|computeChange' ELSE '' END
  || CASE WHEN radar THEN '|analyzeSAREvidence' ELSE '' END || CASE WHEN mixed THEN '|calculateSpatialOverlap' ELSE '' END AS tools,
 facts AS deterministic, CASE WHEN plants AND water THEN 'NDVI|NDWI' WHEN plants THEN 'NDVI' WHEN water THEN 'NDWI' ELSE '' END AS indices
FROM (SELECT id, setup, regexp_matches(q, 'dimension|resolution|crs|epsg|how many bands') AS facts, regexp_matches(q, 'vegetation|ndvi|crop|forest') AS plants,
  regexp_matches(q, 'water|flood|lake|ocean') AS water, n = 2 AND (task IN ('BI_TEMPORAL_ANALYSIS', 'CHANGE_VQA') OR regexp_matches(q, 'change|increase')) AS change,
  task = 'SAR_ANALYSIS' OR rad > 0 OR regexp_matches(q, 'sar|radar') AS radar, task = 'OPTICAL_SAR_ANALYSIS' OR (n = 2 AND opt > 0 AND rad > 0) AS mixed FROM u)"""


@query(f"WITH {SETUP_SQL} {PLAN_SQL}")
def str_evidence_plan(spark, sf):
    plan = lang.evidence_plan(F.col("query"), F.col("task"), F.col("n"), F.col("opt"), F.col("rad"))
    p = _set_up(spark, sf).withColumn("p", plan)
    return p.select("id", "setup", *[F.array_join(f"p.{c}", "|").alias(c) for c in ("measurements", "tools", "indices")], "p.deterministic")


@query(f"""WITH {ALL_SQL} SELECT id, CASE WHEN regexp_matches(q, 'sar|radar|backscatter|roughness') THEN 'SAR'
 WHEN regexp_matches(q, 'cyclone|rainfall|weather|sea surface temperature|sst|ocean color') THEN 'METEOROLOGICAL'
 WHEN regexp_matches(q, 'ndvi|vegetation|chlorophyll|multispectral') THEN 'MULTISPECTRAL' ELSE 'OPTICAL' END AS modality,
 CASE WHEN regexp_matches(q, 'sar|radar|backscatter|roughness') THEN 'SENTINEL-1' WHEN regexp_matches(q, 'cyclone|rainfall|weather|sea surface temperature|sst|ocean color') THEN 'INSAT-3D' END AS satellite,
 CASE WHEN regexp_matches(q, 'mumbai|bombay|maharashtra|western ghats') THEN 'Mumbai / Western Coastal Zone 72.8 18.9 73.1 19.2'
  WHEN regexp_matches(q, 'gujarat|arabian sea') THEN 'Gujarat / Arabian Sea Sector 68.0 20.0 73.0 24.0' ELSE 'Indian Subcontinent Reference Sector 68.0 8.0 96.0 36.0' END AS aoi,
 CASE WHEN regexp_matches(q, 'change|increase|decrease|flood|temporal|before|after') THEN 'BI_TEMPORAL_ANALYSIS' END AS target_task, 20 AS max_cloud FROM q""")
def str_discovery_plan(spark, sf):
    p = _questions(spark, sf).withColumn("p", lang.discovery_plan(F.col("query")))
    aoi = F.concat_ws(" ", "p.aoi_name", F.transform("p.aoi_bbox", lambda x: x.cast("string")))
    return p.select("id", "p.modality", "p.satellite", aoi.alias("aoi"), "p.target_task", "p.max_cloud")


@query("""WITH d AS (SELECT doc_id, lower(text) AS text, [lower(source), lower(lang), 'license'] AS tags, doc_id % 2 = 0 AS pair FROM documents),
t AS (SELECT unnest(['license', 'the', 'flood', 'src1']) AS term),
s AS (SELECT d.doc_id, count(*) FILTER (WHERE contains(text, term)) AS hit,
  sum(CASE WHEN contains(text, term) THEN CASE WHEN len([x FOR x IN tags IF contains(x, term)]) > 0 THEN 15 ELSE 8 END ELSE 0 END) AS pts FROM d, t GROUP BY 1)
SELECT d.doc_id, least(99, floor(20 + pts + hit / 4.0 * 25 + 0.5))::DOUBLE AS score FROM d JOIN s USING (doc_id)
WHERE least(99, floor(20 + pts + hit / 4.0 * 25 + 0.5)) >= 35""")
def str_keyword_relevance(spark, sf):
    d = table(spark, sf, "documents")
    tags_ = F.array(F.lower("source"), F.lower("lang"), F.lit("license"))
    score = lang.relevance(F.lit("License the, flood src1"), F.lower("text"), tags_, F.col("doc_id") % 2 == 0, F.lit(False))
    return d.select("doc_id", score.alias("score")).where("score >= 35")


NAME = "('s2_' || CASE WHEN o_orderkey % 3 = 0 THEN 'sar' ELSE 'img' END || '_' || strftime(o_orderdate, '%Y%m%d') || '.tif')"


@query(f"""SELECT o_orderkey, 'MSI' AS sensor, 'SENTINEL-2' AS satellite, 'optical' AS modality,
 CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def str_file_name(spark, sf):
    o = table(spark, sf, "orders")
    name = F.concat(F.lit("s2_"), F.when(F.col("o_orderkey") % 3 == 0, "sar").otherwise("img"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".tif"))
    f = o.select("o_orderkey", lang.from_file_name(name, F.lit(3)).alias("f"))
    return f.select("o_orderkey", "f.sensor", "f.satellite", "f.modality", F.col("f.date").alias("day"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'scene' ELSE lower(replace(o_orderpriority, '-', '')) END AS part,
 CASE WHEN o_orderstatus = 'F' THEN 'scene' ELSE regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '', 'g') END || '_' || strftime(o_orderdate, '%Y%m%d') || '_'
 || substr(sha256(o_orderkey::VARCHAR), 1, 10) AS scene_id FROM orders""")
def str_scene_id(spark, sf):
    o = table(spark, sf, "orders")
    sensor = F.when(F.col("o_orderstatus") == "F", "UNKNOWN").otherwise(F.col("o_orderpriority"))
    sid = lang.scene_id(sensor, F.date_format("o_orderdate", "yyyy-MM-dd"), F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256))
    part = F.when(F.col("o_orderstatus") == "F", "scene").otherwise(F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit(""))))
    return o.select("o_orderkey", part.alias("part"), sid.alias("scene_id"))


@query("""SELECT page_id, regexp_replace(url, '(_before|_after|_t1|_t2|_epoch[0-9]+).*', '', 'i') || '' AS stem FROM pages""")
def str_stem(spark, sf):
    return table(spark, sf, "pages").select("page_id", lang.stem(F.col("url")).alias("stem"))


@query("""SELECT p_partkey, CASE WHEN contains(u, 'VV') AND contains(u, 'VH') THEN 'VV/VH' WHEN contains(u, 'HH') AND contains(u, 'HV') THEN 'HH/HV'
 WHEN contains(u, 'VV') THEN 'VV' WHEN contains(u, 'VH') THEN 'VH' WHEN contains(u, 'HH') THEN 'HH' WHEN contains(u, 'HV') THEN 'HV' ELSE 'UNKNOWN' END AS polarization
FROM (SELECT p_partkey, upper(p_name || CASE p_size % 5 WHEN 0 THEN ' vv+vh' WHEN 1 THEN ' hh' WHEN 2 THEN ' hv hh' ELSE '' END) AS u FROM part)""")
def str_polarization(spark, sf):
    tail = F.when(F.col("p_size") % 5 == 0, " vv+vh").when(F.col("p_size") % 5 == 1, " hh").when(F.col("p_size") % 5 == 2, " hv hh").otherwise("")
    return table(spark, sf, "part").select("p_partkey", lang.polarization(F.concat("p_name", tail)).alias("polarization"))


@query("SELECT conv_id, turn, [x FOR x IN regexp_split_to_array(lower(trim(text, chr(32) || chr(9) || chr(10) || chr(13))), '[\\s,.;:!?_/\\-]+') IF x <> ''] AS tokens FROM conversations")
def str_tokens(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", lang.tokens(F.col("text")).alias("tokens"))


@query("""SELECT conv_id, turn, '"' || replace(text, '"', '""') || '"' AS field FROM conversations""")
def str_csv_escape(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", lang.csv_field(F.col("text")).alias("field"))


@query("""SELECT a.item_id, b.item_id AS other, lower(trim(a.text)) = lower(trim(b.text)) OR contains(lower(trim(a.text)), lower(trim(b.text))) AS correct
FROM benchmark a JOIN benchmark b ON a.item_id // 4 = b.item_id // 4""")
def str_answer_match(spark, sf):
    a = table(spark, sf, "benchmark")
    b = a.select(F.col("item_id").alias("other"), F.col("text").alias("truth"))
    j = a.join(b, F.floor(F.col("item_id") / 4) == F.floor(F.col("other") / 4))  # four answers each
    return j.select("item_id", "other", lang.answer_matches(F.col("text"), F.col("truth")).alias("correct"))


@query("""WITH b AS (SELECT * FROM (VALUES (0, 'B2'), (1, 'Green 560nm'), (2, 'B4 red'), (3, 'NEAR_INFRARED'), (4, 'RED EDGE'), (5, 'B8A'), (6, 'SWIR1'), (7, 'VV'), (8, 'other')) v(i, d))
SELECT n_nationkey, i, CASE d WHEN 'B2' THEN 'BLUE' WHEN 'Green 560nm' THEN 'GREEN' WHEN 'B4 red' THEN 'RED' WHEN 'NEAR_INFRARED' THEN 'NIR' WHEN 'RED EDGE' THEN 'UNKNOWN'
 WHEN 'B8A' THEN 'NIR' WHEN 'SWIR1' THEN 'SWIR1' WHEN 'VV' THEN 'SAR_VV' ELSE 'UNKNOWN' END AS band FROM nation, b""")
def str_band_identification(spark, sf):
    names = ["B2", "Green 560nm", "B4 red", "NEAR_INFRARED", "RED EDGE", "B8A", "SWIR1", "VV", "other"]
    n = table(spark, sf, "nation").select("n_nationkey", F.posexplode(F.array(*map(F.lit, names))).alias("i", "d"))
    return n.select("n_nationkey", "i", lang.band_of(F.col("d"), F.col("i"), F.lit(9), F.lit(False))["band"].alias("band"))


CONTRACT = "obs AS (SELECT conv_id, turn, role, lower(text) AS q, length(text) AS n FROM conversations)"


@query(f"""WITH {CONTRACT}, s AS (SELECT conv_id, turn, q, {INTENT_SQL} AS intent, n,
 CASE n % 4 WHEN 0 THEN 'STRONG' WHEN 1 THEN 'WEAK' WHEN 2 THEN 'CONFLICTING' ELSE 'MODERATE' END AS state FROM obs)
SELECT conv_id, turn, state AS sufficiency, CASE
 WHEN intent = 'VISUAL_OBSERVATION' AND state <> 'CONFLICTING' THEN 'VERIFIED' WHEN intent = 'VISUAL_OBSERVATION' THEN 'EVIDENCE_CONFLICT'
 WHEN state = 'CONFLICTING' THEN 'EVIDENCE_CONFLICT' WHEN state = 'WEAK' AND n % 3 = 1 THEN 'NEEDS_MORE_DATA' WHEN state = 'WEAK' THEN 'INCONCLUSIVE'
 WHEN n % 3 = 0 AND (intent = 'CAUSAL_ATTRIBUTION' OR contains(q, 'land use') OR contains(q, 'land-use')) THEN 'INCONCLUSIVE' WHEN n % 3 = 0 THEN 'VERIFIED'
 WHEN n % 3 = 1 THEN 'NEEDS_MORE_DATA' ELSE 'INCONCLUSIVE' END AS decision FROM s""")
def str_contract_normalizer(spark, sf):
    from terraspan.functions.gates import normalise_contract

    n = F.length("text")
    raw_s = F.when(n % 4 == 0, "very strong").when(n % 4 == 1, "weak").when(n % 4 == 2, "Conflict found").otherwise("sufficient")
    raw_d = F.when(n % 3 == 0, "verified").when(n % 3 == 1, "need more data").otherwise("inconclusive")
    one, none = F.array(F.lit("x")), F.array().cast("array<string>")
    said = table(spark, sf, "conversations").withColumn("intent", lang.question_intent(F.col("text")))
    k = normalise_contract(F.col("text"), F.col("intent"), raw_s, raw_d, F.lit("high"), one, one, none, none, F.lit(None).cast("string"))
    return said.select("conv_id", "turn", k["sufficiency"].alias("sufficiency"), k["decision"].alias("decision"))


@query(f"""WITH {CONTRACT}, s AS (SELECT conv_id, turn, q, {INTENT_SQL} AS intent FROM obs)
SELECT conv_id, turn, CASE WHEN intent = 'METADATA' THEN 'DETERMINISTIC_ONLY'
 WHEN (intent IN ('TEMPORAL_CHANGE', 'CAUSAL_ATTRIBUTION') OR {any_of(["change", "increased", "decreased", "flood extent", "before and after", "between these images"])})
  AND intent NOT IN ('METADATA', 'VISUAL_OBSERVATION') THEN 'NEEDS_MORE_DATA'
 WHEN {any_of(["ndvi", "vegetation index", "ndwi"])} THEN 'BANDS_UNAVAILABLE'
 WHEN {any_of(["latitude", "longitude", "exact coordinates", "gps coordinates"])} THEN 'GEOREFERENCE_UNAVAILABLE' ELSE 'PROCEED' END AS gate FROM s""")
def gt_abstention(spark, sf):
    from terraspan.functions.gates import abstention

    no = F.lit(False)
    said = table(spark, sf, "conversations").withColumn("intent", lang.question_intent(F.col("text")))
    gate = abstention(F.col("intent"), F.col("text"), F.lit(1), no, no)
    return said.select("conv_id", "turn", gate.alias("gate"))
