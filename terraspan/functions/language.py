"""Plain-language queries and file names as column expressions.

All rule tables are plain data; each function turns one into a single
expression over a text column, so a table of queries is parsed by one narrow
projection without Python workers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.functions.rules import begins, cascade, has, labels, let, matches

#: Fixed values: (trigger pattern, label).
OBJECTS = [
    ("build|structure|building", "built structures"),
    ("road|highway|street", "road network"),
    ("port|harbor|dock|pier|quay", "port infrastructure"),
    ("vessel|ship|boat", "maritime vessels"),
    ("bridge", "bridge"),
    ("dam|reservoir", "reservoir / dam"),
    ("crop|farmland|field", "agricultural parcels"),
]
ACTIONS = [
    ("newly built|new construction|construction|building", "new construction"),
    ("expansion|expanding|growth|growing", "expansion"),
    ("clearance|clearing|cleared", "clearing"),
    ("deforestation|tree loss", "deforestation"),
    ("flood|inundation|water spread", "inundation"),
]
ENVIRONMENT = [
    ("river|stream", "river"),
    ("water|lake|basin", "water body"),
    ("coast|coastal|shore", "coastal zone"),
    ("forest|vegetation|green", "vegetation / forest"),
    ("delta", "delta"),
    ("urban|city|suburb", "urban zone"),
]
TEMPORAL_ACTIONS = ["new construction", "expansion", "change", "deforestation", "inundation", "clearing"]
TEMPORAL_WORDS = "change|expand|growth|newly|before|after|earliest|over time|transition"
MULTIMODAL_WORDS = "multimodal|optical.*sar|sar.*optical|cross-modal|both optical and sar"
PLACES = ["mumbai", "ahmedabad", "gujarat", "visakhapatnam", "godavari", "assam", "brahmaputra", "sundarbans", "bengaluru", "chennai", "delhi"]
STOP_WORDS = "find show search locate detect images imagery scenes where that with using between and from to in of the a an".split()
#: Fixed values: (words, satellite, sensor, modality).
SATELLITES = [
    (["sentinel-2", "sentinel 2", "s2"], "SENTINEL-2", "MSI", "optical"),
    (["sentinel-1", "sentinel 1", "s1"], "SENTINEL-1", "C-SAR", "sar"),
    (["resourcesat", "rs2", "liss"], "RESOURCESAT-2A", "LISS-3", "multispectral"),
    (["cartosat", "carto"], "CARTOSAT-2", "PAN-MX", "optical"),
    (["sar", "radar", "backscatter"], None, None, "sar"),
    (["multispectral", "ndvi", "nir"], None, None, "multispectral"),
    (["optical"], None, None, "optical"),
]


def clean(query: Column) -> Column:
    return F.lower(F.btrim(F.coalesce(query, F.lit("")), F.lit(" \t\n\r\f\x0b")))


def date_range(q: Column) -> Column:
    """struct(start, end) as ISO dates, or null: the years of "between Y and
    Y", "from Y to Y", or "in/during/for 20YY"."""
    pair = [r"between\s+(\d{4})(?:-\d{2})?\s+and\s+(\d{4})(?:-\d{2})?", r"from\s+(\d{4})\s+to\s+(\d{4})"]
    one = r"(?:in|during|for)\s+(20\d{2})"

    def years(a: Column, b: Column) -> Column:
        return F.struct(F.concat(a, F.lit("-01-01")).alias("start"), F.concat(b, F.lit("-12-31")).alias("end"))

    out = F.when(matches(q, pair[0]), years(F.regexp_extract(q, pair[0], 1), F.regexp_extract(q, pair[0], 2)))
    out = out.when(matches(q, pair[1]), years(F.regexp_extract(q, pair[1], 1), F.regexp_extract(q, pair[1], 2)))
    return out.when(matches(q, one), years(F.regexp_extract(q, one, 1), F.regexp_extract(q, one, 1)))


def sensor_of(q: Column, which: str) -> Column:
    """satellite, sensor or modality that a query names; substrings count."""
    k = {"satellite": 1, "sensor": 2, "modality": 3}[which]
    return cascade([(has(q, *row[0]), row[k]) for row in SATELLITES])


def spatial_relation(q: Column, compat: bool = False) -> Column:
    """struct(relation, feature), or null.  A feature ends before a stop word;
    with ``compat`` a feature at the end of the query isn't found."""
    stop = r"(?=\s+(?:between|from|in|using|with|during|$))" if compat else r"(?=\s+(?:between|from|in|using|with|during)(?![A-Za-z0-9_])|\s*$)"
    pattern = rf"(near|along|around|close to|adjacent to|within)\s+([a-z\s]+?){stop}"
    return F.when(
        matches(q, pattern),
        F.struct(
            F.trim(F.regexp_extract(q, pattern, 1)).alias("relation"),
            F.trim(F.regexp_extract(q, pattern, 2)).alias("feature"),
        ),
    )


#: Fields of a search plan, and the parts that are found first for each.
PLAN_FIELDS = {
    "raw_query": [], "intent": ["objects", "actions", "spatial_relation", "date_range", "sensor", "satellite", "modality"],
    "semantic_query": ["actions", "objects", "environment"], "objects": ["objects"], "actions": ["actions"], "environment": ["environment"],
    "spatial_relation": ["spatial_relation"], "date_range": ["date_range"], "sensor": ["sensor"], "satellite": ["satellite"], "modality": ["modality"],
    "aoi_hint": [], "operations": ["objects", "actions", "spatial_relation", "date_range", "sensor", "satellite", "modality"],
}


def parse_query(query: Column, compat: bool = False, only: Sequence[str] | None = None) -> Column:
    """The structured search plan of a query as one struct, with all fields or
    those named in ``only``.  The cleaned query and each part that several
    fields need are bound once, not written out at each use."""
    wanted = [f for f in PLAN_FIELDS if only is None or f in only]
    needed = sorted({part for f in wanted for part in PLAN_FIELDS[f]})

    def part(name: str, q: Column) -> Column:
        if name in ("objects", "actions", "environment"):
            return labels([(matches(q, p), x) for p, x in {"objects": OBJECTS, "actions": ACTIONS, "environment": ENVIRONMENT}[name]])
        if name == "date_range":
            return date_range(q)
        return spatial_relation(q, compat) if name == "spatial_relation" else sensor_of(q, name)

    def intent(q: Column, p: Column) -> Column:
        temporal = p["date_range"].isNotNull() | F.arrays_overlap(p["actions"], F.array(*map(F.lit, TEMPORAL_ACTIONS))) | matches(q, TEMPORAL_WORDS)
        radar = F.coalesce(p["modality"] == "sar", F.lit(False)) | matches(q, "sar|radar|microwave|backscatter")
        return cascade(
            [
                (q == "", "GENERAL_SEMANTIC"),
                (matches(q, MULTIMODAL_WORDS), "MULTIMODAL_SEARCH"),
                (temporal, "TEMPORAL_CHANGE_DISCOVERY"),
                (radar | p["sensor"].isNotNull() | p["satellite"].isNotNull(), "SENSOR_CONSTRAINED_SEARCH"),
                (p["spatial_relation"].isNotNull(), "RELATIONAL_SEARCH"),
                (F.size(p["objects"]) > 0, "OBJECT_SCENE_SEARCH"),
            ],
            "GENERAL_SEMANTIC",
        )

    def field(name: str, q: Column, p: Column) -> Column:
        if name == "raw_query":
            return query
        if name == "intent":
            return intent(q, p)
        if name == "semantic_query":
            # a word's boundary goes by ASCII letters
            stops = r"(?<![A-Za-z0-9_])(" + "|".join(STOP_WORDS) + r")(?![A-Za-z0-9_])"
            bare = F.trim(F.regexp_replace(F.regexp_replace(q, stops, " "), r"\s+", " "))
            concepts = F.concat(p["actions"], p["objects"], p["environment"])
            return F.when(F.size(concepts) > 0, F.array_join(concepts, " ")).otherwise(bare)
        if name == "aoi_hint":
            return F.initcap(cascade([(has(q, x), x) for x in PLACES]))
        if name == "operations":
            steps = ["METADATA_FILTER", "TEXT_EMBEDDING", "VECTOR_SEARCH"]
            more = ["CANDIDATE_RERANKING", "QUALITY_FILTERING"]
            late = ["TEMPORAL_OBSERVATION_COLLECTION", "TEMPORAL_CHANGE_DETECTION", "EARLIEST_CHANGE_VERIFICATION"]
            lists = [F.array(*map(F.lit, x)) for x in (steps, steps + more + late, steps + more)]
            return F.when(q == "", lists[0]).when(intent(q, p) == "TEMPORAL_CHANGE_DISCOVERY", lists[1]).otherwise(lists[2])
        return p[name]

    def plan(q: Column) -> Column:
        parts = F.struct(*[part(n, q).alias(n) for n in needed]) if needed else F.struct(q.alias("q"))
        return let(parts, lambda p: F.struct(*[field(n, q, p).alias(n) for n in wanted]))

    return let(clean(query), plan)


#: Words of each question class, in order of precedence.
INTENT_WORDS = {
    "METADATA": ["metadata", "pixel dimension", "dimensions and bands", "band count", "resolution", "epsg", "crs", "raster header", "file size"],
    "GEO_COORDINATES": ["latitude", "longitude", "exact coordinates", "gps coordinate", "lat/long", "exact location"],
    "QUANTITATIVE_MEASUREMENT": [
        "exact area", "square meter", "sq meter", "square kilometer", "sq km", "hectare", "acre", "exact measurement",
        "exact distance", "sub-pixel", "water depth in meters", "salinity percentage",
    ],
    "SPECTRAL_INDEX": ["ndvi", "ndwi", "evi", "savi", "vegetation index", "water index"],
    "CAUSAL_ATTRIBUTION": [
        "why did", "what caused", "cause of", "caused by", "attributed to", "attribution", "did construction occur",
        "was it construction", "deforestation", "deforested", "flood damage", "disaster damage", "crop type", "specific crop",
        "cleared for agriculture",
    ],
}
CHANGE_WORDS = [
    "change", "difference between", "expand", "increase", "decrease", "shrink", "temporal", "before and after",
    "between these observations", "between these dates", "over time",
]
VISIBLE_WORDS = [
    "what is visible", "is vegetation present", "is water visible", "is water present", "are buildings visible", "visible colors",
    "visible features", "colors and patterns", "shapes and geometric", "textures and light", "visible in this image",
    "visible in these images", "visible patterns", "visible textures", "what do you see", "what is seen",
]
VISIBLE_STARTS = ["what is visible", "describe the visible", "describe what is visible", "describe visible"]
LOOK_WORDS = ["visible", "color", "pattern", "texture", "shape", "feature", "vegetation", "appearance", "describe", "look like"]


def question_intent(query: Column) -> Column:
    """What kind of answer a question asks for."""
    q = clean(query)
    change = has(q, *CHANGE_WORDS)
    seen = has(q, *VISIBLE_WORDS) | begins(q, *VISIBLE_STARTS)
    return cascade(
        [(has(q, *words), name) for name, words in INTENT_WORDS.items()]
        + [
            (seen & ~change, "VISUAL_OBSERVATION"),
            (change, "TEMPORAL_CHANGE"),
            (seen | has(q, *LOOK_WORDS), "VISUAL_OBSERVATION"),
        ],
        "GENERAL",
    )


#: Task words.
TASK_WORDS = {
    "SIMILAR_SITE_DISCOVERY": [
        "similar to this", "find more like this", "similar site", "similar locations", "comparable sites", "locations similar",
        "cluster similar", "more like this", "find similar",
    ],
    "SEMANTIC_RETRIEVAL": [
        "find areas", "find scenes", "find newly", "find locations", "search archive", "search for scenes", "show scenes showing",
        "locate scenes", "retrieve imagery", "find structures", "find vehicles",
    ],
    "METADATA_PROVENANCE": [
        "acquisition date", "sensor and source", "show metadata", "inspect metadata", "acquisition metadata", "what sensor",
        "what satellite", "provenance", "epsg", "crs", "resolution", "pixel dimension", "dimensions and bands",
    ],
    "FALSE_ALARM_ASSESSMENT": [
        "seasonal", "false alarm", "illumination", "sun angle", "shadow artifact", "sensor artifact", "misregistration",
        "registration error", "cloud shadow", "haze", "radiometric",
    ],
    "CHANGE_VERIFICATION": [
        "did construction appear", "did construction occur", "did change occur", "verify change", "confirm change",
        "did building appear", "did structure appear", "assess possible construction", "assess water extent change",
        "did it appear between", "did expansion happen",
    ],
    "MULTITEMPORAL_CHANGE": [
        "what changed", "difference between", "compare observations", "before and after", "temporal change",
        "review change evidence", "what differs", "between these observations", "between these dates",
    ],
    "ANALYST_REVIEW": ["analyst review", "review queue", "audit status", "mark confirmed", "mark rejected"],
}
RETRIEVAL_STARTS = ["find ", "search ", "retrieve "]


def task_class(query: Column, n_images: Column, n_optical: Column, n_sar: Column, before_after: Column, session: Column) -> Column:
    """The task of a question about ``n_images`` images, of which so many are
    optical and radar; ``before_after``: both roles are there; ``session``:
    an earlier turn exists."""
    q = clean(query)
    intent = question_intent(query)
    mixed = (n_images == 2) & (n_optical > 0) & (n_sar > 0)
    starts = begins(q, *RETRIEVAL_STARTS)
    cross = ["sar", "optical", "cross-modal", "complementary"]
    two, visual = n_images == 2, intent == "VISUAL_OBSERVATION"
    rules = []
    for name, words in TASK_WORDS.items():
        found = has(q, *words)
        rules.append((found | starts if name == "SEMANTIC_RETRIEVAL" else found, name))
    rules += [
        (mixed & has(q, *cross, "radar", "compare"), "OPTICAL_SAR_ANALYSIS"),
        (~mixed & (has(q, "sar ", " sar", "radar") | ((n_images == 1) & (n_sar == 1))), "SAR_ANALYSIS"),
        ((n_images == 0) & session, "FOLLOW_UP"),
        ((n_images == 0) & has(q, "show scenes"), "SEMANTIC_RETRIEVAL"),
        (n_images == 0, "UNSUPPORTED_QUERY"),
        (session & has(q, "what did you mean", "why", "expand on", "tell me more", "previous"), "FOLLOW_UP"),
        (two & visual & has(q, "describe", "what is happening", "caption", "what is visible"), "SCENE_DESCRIPTION"),
        (two & visual & mixed, "OPTICAL_SAR_ANALYSIS"),
        (two & visual, "SINGLE_IMAGE_VQA"),
        (two & mixed & has(q, *cross), "OPTICAL_SAR_ANALYSIS"),
        (two & (before_after | has(q, "change", "difference", "temporal", "expand")), "BI_TEMPORAL_ANALYSIS"),
        (two & mixed, "OPTICAL_SAR_ANALYSIS"),
        (two, "BI_TEMPORAL_ANALYSIS"),
        (has(q, "count", "how many"), "COUNTING"),
        (has(q, "where is", "locate", "ground", "bbox"), "TEXT_GUIDED_GROUNDING"),
    ]
    return cascade(rules, "SCENE_INTERPRETATION")


#: Tools that every plan has.
FIRST_TOOLS = ["validateRaster", "inspectBands"]


def evidence_plan(query: Column, task: Column, n_images: Column, n_optical: Column, n_sar: Column) -> Column:
    """struct(measurements, tools, deterministic, indices) that a question of
    a task needs, about ``n_images`` images of which so many are optical and
    radar.  Tools are listed as often as a rule asks for them."""
    q = F.lower(query)
    facts = has(q, "dimension", "resolution", "crs", "epsg", "how many bands")
    plants = has(q, "vegetation", "ndvi", "crop", "forest")
    water = has(q, "water", "flood", "lake", "ocean")
    two = n_images == 2
    change = two & (task.isin("BI_TEMPORAL_ANALYSIS", "CHANGE_VQA") | has(q, "change", "increase"))
    radar = (task == "SAR_ANALYSIS") | (n_sar > 0) | has(q, "sar", "radar")
    mixed = (task == "OPTICAL_SAR_ANALYSIS") | (two & (n_optical > 0) & (n_sar > 0))
    #: Condition, measurements, tools, indices of each rule.
    rules = [
        (facts, ["Dimensions", "BandCount", "GeospatialCRS"], [], []),
        (plants, ["NDVI", "ExcessGreenProxy", "VegetationCandidateRegions"], ["computeSpectralIndex", "analyzeOpticalEvidence"], ["NDVI"]),
        (water, ["WaterLowReflectanceThreshold", "SpecularRadarBackscatter"], ["analyzeOpticalEvidence", "computeSpectralIndex"], ["NDWI"]),
        (change, ["TemporalRegistration", "MeanAbsoluteDifference", "ConfounderScreening"], ["registerTemporalImages", "computeChange"], []),
        (radar, ["SARBackscatterMoments", "SpeckleENL", "PolarizationCheck"], ["analyzeSAREvidence"], []),
        (mixed, ["CommonSpatialGridAlignment", "CrossSensorAgreementCheck"], ["calculateSpatialOverlap"], []),
    ]

    def listed(k: int, first: list[str]) -> Column:
        none = F.array().cast("array<string>")
        parts = [F.when(rule[0], F.array(*map(F.lit, rule[k]))).otherwise(none) for rule in rules if rule[k]]
        return F.concat(F.array(*map(F.lit, first)).cast("array<string>"), *parts)

    return F.struct(
        listed(1, []).alias("measurements"), listed(2, FIRST_TOOLS).alias("tools"), F.coalesce(facts, F.lit(False)).alias("deterministic"), listed(3, []).alias("indices"),
    )


#: Fixed values: (words, area name, bbox).
AREAS = [
    (["mumbai", "bombay", "maharashtra", "western ghats"], "Mumbai / Western Coastal Zone", [72.8, 18.9, 73.1, 19.2]),
    (["gujarat", "arabian sea"], "Gujarat / Arabian Sea Sector", [68.0, 20.0, 73.0, 24.0]),
]
ELSEWHERE = ("Indian Subcontinent Reference Sector", [68.0, 8.0, 96.0, 36.0])


def discovery_plan(query: Column) -> Column:
    """struct(modality, satellite, aoi_name, aoi_bbox, target_task, max_cloud) for a catalogue search."""
    q = F.lower(query)
    radar = has(q, "sar", "radar", "backscatter", "roughness")
    weather = has(q, "cyclone", "rainfall", "weather", "sea surface temperature", "sst", "ocean color")
    plants = has(q, "ndvi", "vegetation", "chlorophyll", "multispectral")

    def box(b: list[float]) -> Column:
        return F.array(*[F.lit(x) for x in b])

    return F.struct(
        cascade([(radar, "SAR"), (weather, "METEOROLOGICAL"), (plants, "MULTISPECTRAL")], "OPTICAL").alias("modality"),
        cascade([(radar, "SENTINEL-1"), (weather, "INSAT-3D")]).alias("satellite"),
        cascade([(has(q, *w), n) for w, n, _ in AREAS], ELSEWHERE[0]).alias("aoi_name"),
        cascade([(has(q, *w), box(b)) for w, _, b in AREAS], box(ELSEWHERE[1])).alias("aoi_bbox"),
        cascade([(has(q, "change", "increase", "decrease", "flood", "temporal", "before", "after"), "BI_TEMPORAL_ANALYSIS")]).alias("target_task"),
        F.lit(20).alias("max_cloud"),
    )


#: Fixed values: (query pattern, points, words of which a tag must contain one).
CONCEPTS = [
    ("urban|city|building|construction|road|infrastructure|built|expansion|settlement", 25, ["urban", "built-up"]),
    ("port|harbor|coastal|ship|vessel|dock|pier|breakwater|sea|ocean|maritime", 25, ["port", "coastal", "breakwater"]),
    ("agri|vegetation|ndvi|crop|farm|chlorophyll|forest|green", 25, ["agri", "vegetation", "ndvi"]),
    ("cloud|monsoon|penetration|obscured|weather", 25, ["cloud"]),
    ("flood|water|inundation|river|lake|overflow", 25, ["flood", "inundation"]),
]
PAIR_WORDS = "change|temporal|before|after|expansion|growth|increase|decrease|transition|difference|over time|year"
RADAR_WORDS = "sar|radar|microwave|backscatter|speckle|polarization|c-band|all-weather"


def _any_word(words: list[str]):
    return lambda x: has(x, *words)


def relevance(query: Column, text: Column, tags: Column, is_pair: Column, is_radar: Column) -> Column:
    """Keyword relevance (0 to 99) of a catalogue item for a query; 80 for a
    query without terms.  ``text`` is all the item's words, lower case."""
    q = F.lower(query)
    terms = F.filter(F.split(q, r"[\s,.;:!?]+"), lambda t: F.length(t) > 1)

    def points(t: Column) -> Column:
        tagged = F.exists(tags, lambda x: F.contains(x, t))
        return F.when(F.contains(text, t), F.when(tagged, F.lit(15.0)).otherwise(F.lit(8.0))).otherwise(F.lit(0.0))

    score = F.lit(20.0) + F.aggregate(terms, F.lit(0.0), lambda a, t: a + points(t))
    found = F.size(F.filter(terms, lambda t: F.contains(text, t)))
    score = score + F.when(F.size(terms) > 0, found / F.size(terms) * 25).otherwise(F.lit(0.0))
    score = score + F.when(matches(q, PAIR_WORDS) & is_pair, F.lit(30.0)).otherwise(F.lit(0.0))
    radar_tag = F.exists(tags, lambda x: F.contains(x, F.lit("radar")))
    score = score + F.when(matches(q, RADAR_WORDS) & (is_radar | radar_tag), F.lit(25.0)).otherwise(F.lit(0.0))
    for pattern, gain, words in CONCEPTS:
        tagged = F.exists(tags, _any_word(words))
        score = score + F.when(matches(q, pattern) & tagged, F.lit(float(gain))).otherwise(F.lit(0.0))
    return F.when(F.size(terms) == 0, F.lit(80.0)).otherwise(F.least(F.lit(99.0), F.floor(score + 0.5).cast("double")))


#: Fixed values: (words in a file name, sensor, satellite, modality).
FILE_SENSORS = [
    (["sentinel-2", "sentinel2", "s2"], "MSI", "SENTINEL-2", None),
    (["sentinel-1", "sentinel1", "s1", "sar"], "C-SAR", "SENTINEL-1", "sar"),
    (["resourcesat", "rs2", "liss"], "LISS-3", "RESOURCESAT-2A", "multispectral"),
    (["cartosat", "carto"], "PAN-MX", "CARTOSAT-2", "optical"),
]
FILE_DATE = r"(20\d{2})[-_]?(0[1-9]|1[0-2])[-_]?(0[1-9]|[12]\d|3[01])"


def from_file_name(file_name: Column, band_count: Column) -> Column:
    """struct(sensor, satellite, modality, date) that a file name tells."""
    f = F.lower(file_name)
    many = F.coalesce(band_count > 4, F.lit(False))
    by_bands = cascade(
        [((band_count == 1) & has(f, "radar", "backscatter"), "sar"), (band_count == 1, "optical"), (band_count > 3, "multispectral")], "optical"
    )
    modality = cascade(
        [(has(f, *w), F.when(many, "multispectral").otherwise("optical") if m is None else m) for w, _, _, m in FILE_SENSORS], by_bands
    )
    day = F.when(
        matches(file_name, FILE_DATE),
        F.concat_ws("-", *[F.regexp_extract(file_name, FILE_DATE, k) for k in (1, 2, 3)]),
    )
    return F.struct(
        cascade([(has(f, *w), s) for w, s, _, _ in FILE_SENSORS], "UNKNOWN").alias("sensor"),
        cascade([(has(f, *w), s) for w, _, s, _ in FILE_SENSORS], "UNKNOWN").alias("satellite"),
        modality.alias("modality"),
        day.alias("date"),
    )


def scene_id(sensor: Column, day: Column, file_hash: Column) -> Column:
    """sensor_date_hash10 with ``scene`` and ``nodate`` where unknown."""
    name = F.when(sensor == "UNKNOWN", F.lit("scene")).otherwise(F.regexp_replace(F.lower(sensor), "[^a-z0-9]", ""))
    return F.concat_ws(
        "_", F.coalesce(name, F.lit("scene")), F.coalesce(F.replace(F.substring(day, 1, 10), F.lit("-"), F.lit("")), F.lit("nodate")),
        F.substring(file_hash, 1, 10),
    )


def stem(file_name: Column) -> Column:
    """A file name without its epoch mark and what follows it."""
    return F.regexp_replace(file_name, r"(?i)(_before|_after|_t1|_t2|_epoch\d+).*", "")


#: Fixed values: (words, exact names, band, wavelength in nm); names first match.
BANDS = [
    (["COASTAL", "443NM"], ["B1"], "COASTAL_AEROSOL", 443),
    (["BLUE", "490NM", "492NM"], ["B2"], "BLUE", 490),
    (["GREEN", "560NM"], ["B3"], "GREEN", 560),
    (["665NM"], ["B4"], "RED", 665),
    (["RED_EDGE_1", "705NM"], ["B5"], "RED_EDGE_1", 705),
    (["RED_EDGE_2", "740NM"], ["B6"], "RED_EDGE_2", 740),
    (["NIR", "NEAR_INFRARED", "842NM", "865NM"], ["B8", "B8A"], "NIR", 842),
    (["SWIR1", "SWIR-1", "1610NM"], ["B11"], "SWIR1", 1610),
    (["SWIR2", "SWIR-2", "2190NM"], ["B12"], "SWIR2", 2190),
    (["PAN"], [], "PAN", None),
    (["VV"], [], "SAR_VV", None),
    (["VH"], [], "SAR_VH", None),
    (["HH"], [], "SAR_HH", None),
    (["HV"], [], "SAR_HV", None),
]


def band_of(description: Column, index: Column, band_count: Column, rgb: Column, compat: bool = False) -> Column:
    """struct(band, wavelength_nm, identified) from a band's description.

    ``rgb``: the raster is a three-band picture or declares RGB.  RED is any
    description with that word but no EDGE; without ``compat`` INFRARED
    doesn't count as RED.
    """
    d = F.upper(F.coalesce(description, F.lit("")))
    red = F.contains(d, F.lit("RED")) & ~F.contains(d, F.lit("EDGE"))
    if not compat:
        red = red & ~F.contains(d, F.lit("INFRARED"))

    def hit(words: list[str], names: list[str], band: str) -> Column:
        out = has(d, *words) | d.isin(names) if names else has(d, *words)
        return out | red if band == "RED" else out

    colour = rgb & (index < 3)
    named = [(hit(w, n, b), b) for w, n, b, _ in BANDS]
    if not compat:
        named.insert(6, (has(d, "SHORTWAVE INFRARED", "SHORT-WAVE INFRARED"), "SWIR1"))
        named.insert(7, (has(d, "NEAR INFRARED", "NEAR-INFRARED"), "NIR"))
    band = cascade(
        named + [(colour & (index == 0), "RED"), (colour & (index == 1), "GREEN"), (colour & (index == 2), "BLUE")], "UNKNOWN"
    )
    known = F.lit(False)
    for condition, _ in named:
        known = known | condition
    waves = F.create_map(*[x for _, _, b, w in BANDS if w for x in (F.lit(b), F.lit(w))])
    return F.struct(band.alias("band"), F.when(known, waves[band]).alias("wavelength_nm"), (band != "UNKNOWN").alias("identified"))


def polarization(text: Column) -> Column:
    t = F.upper(F.coalesce(text, F.lit("")))
    return cascade(
        [(has(t, "VV") & has(t, "VH"), "VV/VH"), (has(t, "HH") & has(t, "HV"), "HH/HV")]
        + [(has(t, p), p) for p in ("VV", "VH", "HH", "HV")],
        "UNKNOWN",
    )


def tokens(text: Column) -> Column:
    """The words of a text for the text embedding."""
    return F.filter(F.split(clean(text), r"[\s,.;:!?_/\-]+"), lambda t: F.length(t) > 0)


def file_format(file_name: Column, mime: Column, content: Column) -> Column:
    """Raster format by extension or MIME type, else by the first bytes."""
    ext = F.regexp_extract(F.lower(file_name), r"(\.[^./]+)$", 1)
    mime = F.lower(F.coalesce(mime, F.lit("")))
    head = F.hex(F.substring(content, 1, 4))
    return cascade([
        (ext.isin(".tif", ".tiff", ".geotiff") | has(mime, "tiff"), "GeoTIFF"),
        ((ext == ".png") | has(mime, "png"), "PNG"),
        (ext.isin(".jpg", ".jpeg") | has(mime, "jpeg"), "JPEG"),
        (F.length(content) < 4, "UNKNOWN"),
        (head.isin("49492A00", "4D4D002A"), "GeoTIFF"),
        (head == "89504E47", "PNG"),
        (F.startswith(head, F.lit("FFD8")), "JPEG"),
    ], "UNKNOWN")


def csv_field(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def area_text(m2: Column) -> Column:
    return F.when(m2 > 1_000_000, F.concat(F.format_number(m2 / 1_000_000, 2), F.lit(" km²"))).otherwise(
        F.concat(F.format_number(m2, 0), F.lit(" m²"))
    )


def bytes_text(n: Column) -> Column:
    kb = 1024.0
    return cascade([
        (n < kb, F.concat(n.cast("string"), F.lit(" B"))),
        (n < kb**2, F.format_string("%.1f KB", n / kb)),
        (n < kb**3, F.format_string("%.1f MB", n / kb**2)),
    ], F.format_string("%.2f GB", n / kb**3))


def answer_matches(predicted: Column, truth: Column) -> Column:
    """Whether an answer equals or contains the expected one."""
    p, t = F.lower(F.trim(predicted)), F.lower(F.trim(truth))
    return (p == t) | F.contains(p, t)


def with_plan(queries: DataFrame, text: str = "query", compat: bool = False, only: Sequence[str] | None = None) -> DataFrame:
    return queries.withColumn("plan", parse_query(F.col(text), compat, only))
