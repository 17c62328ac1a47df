"""Quality gates and decision cascades of pairs of observations.

Every gate is one ``CASE`` on codes; texts for people are made elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraspan.functions.rules import cascade, has

#: Fixed values.
MAX_CLOUD, SERIES_MAX_CLOUD = 40.0, 50.0
NO_CHANGE_BELOW, POSSIBLE_FROM, SUPPORTED_FROM, SEASONAL_BELOW = 2.0, 4.0, 8.0, 18.0
ONSET_FROM = 10.0


def registration(crs_a: Column, crs_b: Column, epsg_a: Column, epsg_b: Column, w_a: Column, h_a: Column, w_b: Column, h_b: Column,
                 res_a: Column, res_b: Column) -> Column:
    bare = crs_a.isNull() | (crs_a == "unavailable") | crs_b.isNull() | (crs_b == "unavailable")
    ratio = res_a / res_b
    known = epsg_a.isNotNull() & epsg_b.isNotNull()
    return cascade([
        (bare & (w_a == w_b) & (h_a == h_b), "PARTIALLY_ALIGNED"),
        (bare, "REGISTRATION_UNCERTAIN"),
        (known & (epsg_a != epsg_b), "PARTIALLY_ALIGNED"),
        (known & ((ratio < 0.5) | (ratio > 2.0)), "REGISTRATION_UNCERTAIN"),
        (known, "ALIGNED"),
    ], "NOT_AVAILABLE")


def month_distance(a: Column, b: Column) -> Column:
    d = F.abs(F.month(a) - F.month(b))
    return F.least(d, 12 - d)


def seasonality(a: Column, b: Column) -> Column:
    """HIGH across monsoon (6-9) and dry months (12-3) or from five months
    on, MEDIUM from three, else NONE; NONE if a date is missing."""
    m, n = F.month(a), F.month(b)
    wet_a, wet_b, dry_a, dry_b = m.between(6, 9), n.between(6, 9), (m == 12) | (m <= 3), (n == 12) | (n <= 3)
    d = month_distance(a, b)
    return cascade([((wet_a & dry_b) | (dry_a & wet_b) | (d >= 5), "HIGH"), (d >= 3, "MEDIUM")], "NONE")


def cloud(a: Column, b: Column, limit: float = MAX_CLOUD) -> Column:
    most = F.greatest(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0)))
    return cascade([(a.isNull() & b.isNull(), "NOT_AVAILABLE"), (most > limit, "CONTAMINATED")], "USABLE")


def sensor_relationship(sensor_a: Column, sensor_b: Column, mod_a: Column, mod_b: Column) -> Column:
    return F.when((sensor_a == sensor_b) & (mod_a == mod_b), "SAME_SENSOR").otherwise("CROSS_SENSOR_COMPARISON")


def persistence(epochs: Column) -> Column:
    """PERSISTENT from three epochs on.  No ratio is given: none is measured."""
    return F.when(epochs >= 3, "PERSISTENT").otherwise("UNCERTAIN")


def overall_quality(registration: Column, season: Column, cloud: Column, relation: Column) -> Column:
    return cascade([
        ((registration == "REGISTRATION_FAILED") | (cloud == "CONTAMINATED"), "UNUSABLE"),
        (registration.isin("REGISTRATION_UNCERTAIN", "PARTIALLY_ALIGNED") | (season == "HIGH") | (relation == "CROSS_SENSOR_COMPARISON"), "DEGRADED"),
    ], "USABLE")


def decision(registration: Column, cloud: Column, relation: Column, mod_a: Column, mod_b: Column, season: Column, change_pct: Column,
             n_regions: Column, n_strong: Column, strong_building: Column, strong_class: Column, first_class: Column) -> Column:
    """struct(status, class, grade, rule) of the false-alarm cascade.

    ``strong_building``: a region is CONSTRUCTION and STRONG; ``strong_class``
    and ``first_class``: the meaning of the largest strong region and of the
    largest region.
    """
    cross = (relation == "CROSS_SENSOR_COMPARISON") & (
        ((mod_a == "optical") & (mod_b == "sar")) | ((mod_a == "sar") & (mod_b == "optical"))
    )
    good = registration.isin("ALIGNED", "PARTIALLY_ALIGNED")
    rules = [
        (registration == "REGISTRATION_FAILED", "REGISTRATION_UNCERTAIN", F.lit("UNKNOWN"), "REJECTED"),
        (cloud == "CONTAMINATED", "LOW_QUALITY", F.lit("UNKNOWN"), "REJECTED"),
        (cross, "CROSS_SENSOR_UNCERTAIN", F.lit("UNKNOWN"), "LOW"),
        ((change_pct < NO_CHANGE_BELOW) & (n_regions == 0), "NO_SIGNIFICANT_CHANGE", F.lit("UNKNOWN"), "HIGH"),
        ((season == "HIGH") & (change_pct < SEASONAL_BELOW) & ~strong_building, "LIKELY_SEASONAL_VARIATION", F.lit("VEGETATION_CHANGE"), "MEDIUM"),
        (good & (n_strong > 0) & (change_pct >= SUPPORTED_FROM), "SUPPORTED_CHANGE", strong_class, "HIGH"),
        (change_pct >= POSSIBLE_FROM, "POSSIBLE_CHANGE", F.coalesce(first_class, F.lit("UNKNOWN")), "MEDIUM"),
    ]
    return F.struct(
        cascade([(c, s) for c, s, _, _ in rules], "INSUFFICIENT_EVIDENCE").alias("status"),
        cascade([(c, k) for c, _, k, _ in rules], "UNKNOWN").alias("class"),
        cascade([(c, g) for c, _, _, g in rules], "LOW").alias("grade"),
        cascade([(c, k + 1) for k, (c, *_) in enumerate(rules)], len(rules) + 1).alias("rule"),
    )


def evidence_registration(dw: Column, dh: Column, crs_a: Column, crs_b: Column, rx_a: Column, ry_a: Column, rx_b: Column, ry_b: Column,
                          overlap: Column) -> Column:
    """struct(status, risk): sizes within two pixels, equal CRS, resolutions
    within 5 %; ``overlap`` is null without bounds."""
    same_size = (dw <= 2) & (dh <= 2)
    same_crs = crs_a.isNull() | crs_b.isNull() | (crs_a == crs_b)
    known = rx_a.isNotNull() & rx_b.isNotNull()
    same_res = ~(known & ((F.abs(rx_a - rx_b) > 0.05 * F.abs(rx_a)) | (F.abs(ry_a - ry_b) > 0.05 * F.abs(ry_a))))
    apart = F.coalesce(overlap == 0, F.lit(False))
    wrong = ~same_size | ~same_crs | ~same_res
    far = (~same_size & ((dw > 100) | (dh > 100))) | ~same_crs
    return F.struct(
        cascade([(apart, "INCOMPATIBLE_RASTERS"), (wrong, "REGISTRATION_REQUIRED")], "ALIGNED").alias("status"),
        cascade([(apart | (wrong & far), "HIGH"), (wrong, "MEDIUM")], "LOW").alias("risk"),
    )


def confounders(mad: Column, changed: Column, shift: Column, mean_a: Column, mean_b: Column, is_sar: Column, profile: str = "evidence") -> Column:
    """struct(illumination, cloud, changed); profiles ``evidence`` (shift over
    22 and within 12 of the difference, change over 4 %) and ``legacy`` (20,
    10, 5 %)."""
    least, near, share = (22, 12, 0.04) if profile == "evidence" else (20, 10, 0.05)
    light = (shift > least) & (F.abs(mad - shift) < near)
    return F.struct(
        light.alias("illumination"),
        (~is_sar & ((mean_a > 210) | (mean_b > 210)) & (changed > 0.35)).alias("cloud"),
        ((changed > share) & ~light).alias("changed"),
    )


def cross_modal_pair(category: Column, kind: Column) -> Column:
    """CONFIRMING or CONTRADICTING for overlapping optical and radar regions."""
    water, built = category == "WATER_CANDIDATE", category == "BUILT_UP_CANDIDATE"
    low, high = kind == "LOW_BACKSCATTER_SPECULAR", kind == "HIGH_BACKSCATTER_DOUBLE_BOUNCE"
    return cascade([((water & low) | (built & high), "CONFIRMING"), ((built & low) | (water & high), "CONTRADICTING")])


def cross_modal_status(conflict: Column, confirm: Column, n_optical: Column, n_sar: Column) -> Column:
    return cascade([(conflict, "CONFLICT"), (confirm, "AGREEMENT"), ((n_optical == 0) & (n_sar == 0), "INSUFFICIENT_DATA")], "COMPLEMENTARY")


def cross_modal_metrics(opt_dark: Column, opt_bright: Column, opt_rough: Column, sar_dark: Column, sar_bright: Column) -> Column:
    """The same from image-wide shares."""
    water, built = opt_dark > 0.1, (opt_bright > 0.05) & (opt_rough > 0.1)
    bad = (water & (sar_dark <= 0.08)) | (built & (sar_bright <= 0.04))
    return cascade([(bad, "CONFLICT"), (water | built, "AGREEMENT")], "COMPLEMENTARY")


def image_relationship(n: Column, any_sar: Column, any_optical: Column, before_after: Column, temporal_query: Column, aspect_ratio: Column,
                       apart: Column, bands: Column) -> Column:
    """How several images relate, in order of precedence."""
    return cascade([
        (n == 1, "SINGLE_IMAGE"),
        ((aspect_ratio > 2.5) | apart, "INCOMPATIBLE"),
        (bands, "MULTISPECTRAL"),
        (any_sar & any_optical, "OPTICAL_SAR"),
        (before_after | temporal_query, "TEMPORAL"),
        (any_sar & ~any_optical, "MULTI_SAR"),
    ], "MULTIPLE_VIEWS")


def abstention(intent: Column, query: Column, n_images: Column, has_nir: Column, has_crs: Column) -> Column:
    """The gate that answers a question without looking at pixels, if any."""
    q = F.lower(query)
    temporal = intent.isin("TEMPORAL_CHANGE", "CAUSAL_ATTRIBUTION") | has(q, "change", "increased", "decreased", "flood extent", "before and after", "between these images")
    temporal = temporal & ~intent.isin("METADATA", "VISUAL_OBSERVATION")
    return cascade([
        ((intent == "METADATA") & (n_images > 0), "DETERMINISTIC_ONLY"),
        (temporal & (n_images == 1), "NEEDS_MORE_DATA"),
        (has(q, "ndvi", "vegetation index", "ndwi") & ~has_nir & (n_images == 1), "BANDS_UNAVAILABLE"),
        (has(q, "latitude", "longitude", "exact coordinates", "gps coordinates") & ~has_crs & (n_images > 0), "GEOREFERENCE_UNAVAILABLE"),
    ], "PROCEED")


def attribution(decision: Column, causal: Column, contradicting: Column, alternatives: Column) -> Column:
    """A verified answer is only kept if the question isn't causal and not
    both contradicted and open to other explanations."""
    doubt = causal | ((contradicting > 0) & (alternatives > 0))
    return F.when((decision == "VERIFIED") & doubt, "INCONCLUSIVE").otherwise(decision)


def escalation(sufficiency: Column, confidence: Column, conflict: Column) -> Column:
    """Whether a second look is due; confidence alone never settles it."""
    return cascade([
        (conflict | (sufficiency == "CONFLICTING"), "ESCALATE_CONFLICT"),
        (sufficiency.isin("INSUFFICIENT", "WEAK"), "ESCALATE_EVIDENCE"),
        (confidence == "Low", "ESCALATE_CONFIDENCE"),
    ], "ACCEPT")


def two_image_answer(season: Column, mad: Column, registered: Column, changed: Column) -> Column:
    """The answer gate of an image pair; missing measurements give
    INSUFFICIENT_EVIDENCE, never a made-up value."""
    return cascade([
        (mad.isNull() | changed.isNull(), "INSUFFICIENT_EVIDENCE"),
        (season == "HIGH", "LIKELY_SEASONAL_VARIATION"),
        (mad < 5, "NO_SIGNIFICANT_CHANGE"),
        (~registered, "REGISTRATION_UNCERTAIN"),
        (changed.between(0.015, 0.25), "SUPPORTED_CHANGE"),
    ], "POSSIBLE_CHANGE")


#: Words of the contract's enumerations, in order.
SUFFICIENCY_WORDS = [
    (["CONFLICT"], "CONFLICTING"), (["WEAK"], "WEAK"), (["INSUFFICIENT", "NONE", "ZERO"], "INSUFFICIENT"), (["STRONG"], "STRONG"),
    (["MODERATE", "SUFFICIENT"], "MODERATE"),
]
CONFIDENCE_WORDS = [(["HIGH", "VERIFIED"], "High"), (["LOW"], "Low"), (["NOT", "NONE"], "Not Calibrated")]


def normalise_contract(query: Column, intent: Column, raw_sufficiency: Column, raw_decision: Column, raw_confidence: Column, observations: Column,
                       supporting: Column, contradicting: Column, alternatives: Column, engine_state: Column) -> Column:
    """struct(sufficiency, confidence, decision) of a model's answer: enums by
    substring, defaults from the evidence, then gated decisions."""
    def arr(c: Column) -> Column:
        return F.coalesce(F.size(F.filter(c, lambda x: F.trim(x) != "")), F.lit(0))

    visual = intent == "VISUAL_OBSERVATION"
    q = F.lower(query)
    causal = (intent == "CAUSAL_ATTRIBUTION") | has(q, "land-use", "land use")
    suff, dec, conf = (F.upper(F.trim(F.coalesce(c, F.lit("")))) for c in (raw_sufficiency, raw_decision, raw_confidence))
    seen, backed = arr(observations) > 0, arr(supporting) > 0
    by_evidence = cascade([
        (visual & seen, "STRONG"), (visual, "INSUFFICIENT"), (~seen | ~backed, "INSUFFICIENT"), (has(dec, "CONFLICT"), "CONFLICTING"),
    ], "MODERATE")
    state = cascade([(has(suff, *w), v) for w, v in SUFFICIENCY_WORDS], by_evidence)
    state = cascade([
        (engine_state == "CONFLICTING", "CONFLICTING"),
        ((engine_state == "INSUFFICIENT") & (state != "CONFLICTING") & ~visual, "INSUFFICIENT"),
    ], state)
    need = F.when(has(dec, "EVIDENCE"), "NEEDS_MORE_EVIDENCE").otherwise("NEEDS_MORE_DATA")
    asks = has(dec, "NEED", "MORE")
    doubted = (arr(contradicting) > 0) & (arr(alternatives) > 0)
    decided = cascade([
        (visual & seen & (state != "CONFLICTING"), F.lit("VERIFIED")),
        (visual & ((state == "CONFLICTING") | has(dec, "CONFLICT")), F.lit("EVIDENCE_CONFLICT")),
        (visual, F.lit("INCONCLUSIVE")),
        ((state == "CONFLICTING") | has(dec, "CONFLICT"), F.lit("EVIDENCE_CONFLICT")),
        (state.isin("INSUFFICIENT", "WEAK") & asks, need),
        (state.isin("INSUFFICIENT", "WEAK"), F.lit("INCONCLUSIVE")),
        (has(dec, "VERIFIED") & (causal | doubted), F.lit("INCONCLUSIVE")),
        (has(dec, "VERIFIED"), F.lit("VERIFIED")),
        (has(dec, "INCONCLUSIVE"), F.lit("INCONCLUSIVE")),
        (asks, need),
        (causal, F.lit("INCONCLUSIVE")),
    ], "VERIFIED")
    return F.struct(
        state.alias("sufficiency"), cascade([(has(conf, *w), v) for w, v in CONFIDENCE_WORDS], "Moderate").alias("confidence"), decided.alias("decision"),
    )
