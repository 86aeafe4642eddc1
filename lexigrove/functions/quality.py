"""Quality of a page's text layer and where the page goes: column expressions, and lexical quality over a word list table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.config import Settings
from lexigrove.functions.tally import LETTERS, char_counts, word_counts, words_by_text
from lexigrove.functions.text import density_score, lang_hint, once, strip
from lexigrove.sources.tables import stored

S = Settings()
# Designations that are no misspelled words, by whole token; then identifiers of structured documents (case counts).
TECHNICAL = (
    r"(?i)^(?:mil(?:-[a-z0-9]+)+|amcp(?:-[0-9]+)*|astm[a-z0-9-]*|gost[a-z0-9-]*|iso[0-9-]+|iec[0-9-]+|kt-?[0-9a-z-]+|ap-?[0-9a-z-]+|faa[a-z0-9-]*|nasa[a-z0-9-]*"
    r"|doi[:0-9.]+|[a-z]?[0-9]+(?:[.-][0-9a-z]+)+|[0-9]+(?:[.,][0-9]+)?(?:w|kw|mhz|hz|v|a|mm|cm|m|kg|lb|in|ft|psi|°?[cf])?|w/in\.?|ref\.?)$"
)
IDENTIFIER = r"^(?:[a-z]+(?:[A-Z][a-z0-9]+)+|[A-Z]{2,}[A-Z0-9_-]{2,}|<.?/?[A-Za-z][A-Za-z0-9_:.-]*>?|S1000DR?[A-Za-z0-9_-]*)$"
JUNK_SHAPE = r"[A-Za-z]{2,}[0-9]{2,}[A-Za-z]+|[~^*=_]|(.)\1{3,}"
WORD = r"[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё0-9/-]+"
# Characters a clean text layer may hold beside white space and ASCII.
PRINTABLE = "«»—–−°±×÷№§…ёЁА-Яа-я"
# Weights of the text-layer score, and of lexical quality.
WEIGHTS = {"printable": 0.30, "language": 0.20, "geometry": 0.20, "density": 0.15, "visual": 0.15}
LEXICAL = {"hit": 0.60, "known": 0.25, "clean": 0.15, "weak": 0.35}

_count = lambda c, p: F.regexp_count(c, F.lit(p))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def alpha_len(c: Column) -> Column:
    return _count(c, r"\p{L}")


def words(c: Column) -> Column:
    """Tokens that begin with a letter, of two characters or more; digits, hyphens and slashes may follow."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def is_technical(token: Column) -> Column:
    bare = F.regexp_replace(token, "^[<>/]+|[<>/]+$", "")
    return token.rlike(TECHNICAL) | token.rlike(IDENTIFIER) | bare.rlike(TECHNICAL) | bare.rlike(IDENTIFIER)


def is_typo_shaped(token: Column) -> Column:
    """Digits inside letters, stray signs, a character four times; or five letters and (nearly) no vowel."""
    low, n = F.lower(token), alpha_len(token)
    latin, cyrillic = token.rlike("[A-Za-z]"), token.rlike("[Ѐ-ӿ]")
    english, all_ = _count(low, "[aeiouy]"), _count(low, "[аеёиоуыэюяaeiouy]")
    bare = latin & ~cyrillic & ((english == 0) | ((english / n < 0.12) & (n >= 7)))
    return token.rlike(JUNK_SHAPE) | ((n >= 5) & (bare | (cyrillic & (all_ == 0))))


def printable_ratio(c: Column) -> Column:
    ok = char_counts(c, ok=rf"\x09-\x0D\x20-\x7E\u0085\u00A0\u2000-\u200A\u2028\u2029\u3000{PRINTABLE}").ok
    return F.when(F.length(c) == 0, 0.0).otherwise(ok / F.length(c))


def language_score(c: Column) -> Column:
    """Coherent Cyrillic or Latin text, not a soup of symbols."""
    def score(n: Column) -> Column:
        a, b = n.cyr / (n.cyr + n.lat), n.lat / (n.cyr + n.lat)
        latin = F.when(n.words >= 3, 0.75 + 0.2 * F.least(F.lit(1.0), n.words / 20)).otherwise(0.45)
        return (
            F.when(n.letters == 0, 0.35).when(n.cyr + n.lat == 0, 0.2)
            .when(a >= 0.45, 0.65 + 0.35 * a).when(b >= 0.75, latin).when(a >= 0.2, 0.55).otherwise(0.3)
        )

    counts = char_counts(c, words="A-Za-z", letters=LETTERS, cyr="Ѐ-ӿ", lat="A-Za-z")
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", 0.0).otherwise(once(counts, score))


def geometry_scores(spans: DataFrame) -> DataFrame:
    """(doc_id, page, geometry) from spans (doc_id, page, span_ord, box, page_w, page_h): valid boxes, reading order, coverage.

    One array of boxes a page; a page is one row of its own, whatever the size of its document.
    """
    b = F.col("box")
    valid = (b.x2 > b.x1) & (b.y2 > b.y1) & (b.x1 >= -1) & (b.y1 >= -1) & (b.x2 <= F.col("page_w") + 1) & (b.y2 <= F.col("page_h") + 1)
    near = F.concat_ws(",", *(F.round(b[k], 1) for k in ("x1", "y1", "x2", "y2")))
    g = spans.groupBy("doc_id", "page").agg(
        F.count("*").alias("n"), F.sum(valid.cast("int")).alias("ok"), F.sum(F.when(valid, (b.x2 - b.x1) * (b.y2 - b.y1)).otherwise(0.0)).alias("area"), F.countDistinct(near).alias("distinct"),
        F.max("page_w").alias("w"), F.max("page_h").alias("h"), F.sort_array(F.collect_list(F.when(valid, F.struct("span_ord", ((b.y1 + b.y2) / 2).alias("y"))))).alias("c"),
    )
    ys = F.col("c.y")
    back = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(ys) - 1, F.lit(1))), lambda i: F.coalesce(F.get(ys, i) + 2 < F.get(ys, i - 1), F.lit(False))))
    order = F.when(F.size(ys) >= 3, clamp01(1 - back / (F.size(ys) - 1))).otherwise(1.0)
    twice = F.when(F.col("n") >= 8, clamp01(1 - F.col("distinct") / F.col("n"))).otherwise(0.0)
    share = F.col("area") / (F.col("w") * F.col("h"))
    cover = F.when(share > 3, 0.2).when(share > 1.5, 0.5).when((share < 0.001) & (F.col("n") > 5), 0.4).otherwise(1.0)
    score = clamp01(0.45 * F.col("ok") / F.col("n") + 0.30 * order + 0.25 * cover * (1 - twice))
    return g.select("doc_id", "page", F.when((F.col("w") <= 0) | (F.col("h") <= 0), 0.0).otherwise(score).alias("geometry"))


def text_layer_score(text: Column, geometry: Column, page_w: Column, page_h: Column, visual: Column) -> Column:
    """Weighted score; without a visual term (null) the other weights are taken to sum to one. No layer scores zero."""
    w = WEIGHTS
    base = w["printable"] * printable_ratio(text) + w["language"] * language_score(text) + w["geometry"] * geometry + w["density"] * density_score(F.length(text), page_w * page_h)
    score = F.when(visual.isNull(), base / (1 - w["visual"])).otherwise(base + w["visual"] * visual)
    return F.when((strip(text) == "") & (geometry == 0), 0.0).otherwise(clamp01(score))


def lexicon(corpus: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, zipf) from a corpus: log10 of a word's count in a billion words of its language.

    Stands in for a list of word frequencies that is not shipped; thresholds are parameters of ``lexical_quality``.
    """
    # stored, as the totals read it too and texts should be cut once
    n = stored(word_counts(corpus.select(F.col(lang).alias("lang"), F.lower(F.col(text)).alias("text")), "text", WORD, "lang"))
    total = n.groupBy("lang").agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total), "lang").select("lang", "word", F.log10(F.col("n") * 1e9 / F.col("total")).alias("zipf"))  # one row a language


def lexical_quality(pages: DataFrame, known: DataFrame, hit: float = 3.0, weak: float = 1.5, veto: float = 0.75, oov_veto: float = 0.18, least: int = 25, letters: int = 5, samples: int = 12) -> DataFrame:
    """Per page of ``pages`` (page_id, text): quality, dict_hit, typo_ratio, oov_hard, n_tokens, lang_hint, vetoed, sample of bad tokens.

    ``known``: (lang, word, zipf). Distinct tokens of all pages meet the word list and are judged once; pages count theirs without a shuffle
    and meet the judged ones, which are stored so that few are shipped and many are joined.
    """
    t = word_counts(pages, "text", WORD).select(F.col("word").alias("token"), alpha_len(F.col("word")).alias("alpha")).where("alpha >= 2").withColumn("long", F.col("alpha") >= letters)
    base = F.lower(F.when((F.length("token") > 3) & F.col("token").endswith("-"), F.expr("left(token, length(token) - 1)")).otherwise(F.col("token")))
    best = known.groupBy("word").agg(F.max("zipf").alias("zipf"))
    t = t.withColumn("word", base).join(best, "word", "left").withColumn("z", F.coalesce("zipf", F.lit(0.0)))
    tech = is_technical(F.col("token"))
    hit_, weak_ = tech | (F.col("z") >= hit), ~tech & (F.col("z") < hit) & (F.col("z") >= weak)
    oov = ~tech & (F.col("z") < weak)
    typo = oov | (weak_ & (is_typo_shaped(F.col("token")) | F.col("token").endswith("-")))
    judged = stored(t.select("token", "long", *(c.alias(k) for k, c in (("is_hit", hit_), ("is_weak", weak_), ("is_oov", oov), ("is_typo", typo)))))
    t = words_by_text(pages, "page_id", "text", WORD).withColumnRenamed("word", "token").join(judged, "token")
    t = t.select("page_id", "long", "at", "token", "n", *(F.when(c, F.col("n")).otherwise(0).alias(k) for k, c in ((k, F.col(f"is_{k}")) for k in ("hit", "weak", "oov", "typo"))))
    sums = lambda on: [F.sum(F.when(on, F.col(k)).otherwise(0)).alias(k) for k in ("n", "hit", "weak", "oov", "typo")]
    both = t.groupBy("page_id").agg(F.struct(*sums(F.col("long"))).alias("a"), F.struct(*sums(F.lit(True))).alias("b"), F.sort_array(F.collect_list(F.when(F.col("typo") > 0, F.struct("at", "token", "long")))).alias("bad"))
    got = both.select("page_id", F.when(F.col("a.n") > 0, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(F.col("a.n") > 0, F.expr("filter(bad, x -> x.long)")).otherwise(F.col("bad")).alias("bad"))
    s, w = F.col("s"), LEXICAL
    quality = clamp01(w["hit"] * (s.hit + w["weak"] * s.weak) / s.n + w["known"] * (1 - s.oov / s.n) + w["clean"] * (1 - s.typo / s.n))
    got = got.select("page_id", quality.alias("quality"), *(F.round(s[k] / s.n, 4).alias(a) for k, a in (("hit", "dict_hit"), ("typo", "typo_ratio"), ("oov", "oov_hard"))), s.n.alias("n_tokens"), F.slice(F.expr("transform(bad, x -> x.token)"), 1, samples).alias("bad_tokens"), (s.oov / s.n).alias("oov"))
    out = pages.select("page_id", lang_hint(F.col("text")).alias("lang_hint")).join(got, "page_id", "left")
    none = {"quality": 0.0, "dict_hit": 0.0, "typo_ratio": 0.0, "oov_hard": 0.0, "n_tokens": 0, "oov": 0.0}
    out = out.na.fill(none).withColumn("vetoed", (F.col("n_tokens") >= least) & ((F.col("quality") < veto) | (F.col("oov") >= oov_veto))).drop("oov")
    return out.withColumn("garbage", 1 - F.col("quality")).withColumn("bad_tokens", F.coalesce("bad_tokens", F.array().cast("array<string>")))


def page_class(layer: Column, chars: Column, score: Column, lexical: Column, dict_hit: Column, oov: Column, vetoed: Column, threshold: float = 0.65, lex_b: float = 0.62, dict_b: float = 0.58) -> Column:
    """A clean, B lightly damaged, C to be read from the image. Unknown lexical quality (null) satisfies nothing."""
    good = score >= threshold
    light = (lexical >= lex_b) & (dict_hit >= dict_b) & (oov <= 0.32) & ((score >= 0.55) | vetoed)
    return (
        F.when(~layer | (chars < 40), "C").when(~good & (lexical.isNull() | (lexical < 0.55)), "C").when(~vetoed & good & (lexical >= 0.85), "A")
        .when((chars >= 200) & (F.coalesce(light, F.lit(False)) | (~vetoed & good)), "B").when(vetoed | F.coalesce(lexical < lex_b, F.lit(False)), "C").when(~good, "C").otherwise("B")
    )


def route(layer: Column, score: Column, vetoed: Column, threshold: float = 0.65) -> Column:
    return F.when(layer & (score >= threshold) & ~vetoed, "text_layer").otherwise("ocr")


# Weights of the image score's six parts, bounds of its levels, steps by level.
IMAGE_WEIGHTS = {"resolution": 0.20, "blur": 0.25, "noise": 0.15, "contrast": 0.20, "skew": 0.10, "compression": 0.10}
LEVELS = {"good": 0.72, "medium": 0.45}
STEPS = {
    "good": ["render", "deskew"], "medium": ["render", "deskew", "mild_denoise", "contrast_normalization"],
    "bad": ["render", "deskew", "denoise", "contrast_enhancement", "high_resolution_bands"],
}


def image_score(parts: dict[str, Column]) -> Column:
    """Weighted score of image measures that a port delivers, each in 0..1."""
    return clamp01(sum((w * clamp01(parts[k]) for k, w in IMAGE_WEIGHTS.items()), F.lit(0.0)))


def image_level(score: Column) -> Column:
    return F.when(score >= LEVELS["good"], "good").when(score >= LEVELS["medium"], "medium").otherwise("bad")


def preprocess_plan(level: Column, binarize: bool = False) -> Column:
    """Names of the steps for a page image, in order."""
    steps = {k: F.array(*map(F.lit, v + ["binarize"] * binarize)) for k, v in STEPS.items()}
    return F.when(level == "good", steps["good"]).when(level == "medium", steps["medium"]).otherwise(steps["bad"])


def horizontal_bands(height: Column, band: int = 1600, overlap: float = 0.12) -> Column:
    """Array of (top, bottom) over the full width; neighbours overlap, the last one ends at the bottom."""
    step = max(1, int(band * (1 - overlap)))
    tops = F.filter(F.sequence(F.lit(0), F.greatest(height - 1, F.lit(0)), F.lit(step)), lambda t: (t == 0) | (t - F.lit(step) + F.lit(band) < height))
    return F.when(height <= 0, F.array().cast("array<struct<top:int,bottom:int>>")).otherwise(F.transform(tops, lambda t: F.struct(t.cast("int").alias("top"), F.least(t + F.lit(band), height).cast("int").alias("bottom"))))


def problem_flags(c: Column, repaired: Column | None = None) -> Column:
    """Audit flags of a page: markup, Greek lookalikes (what repair would change), control characters, broken words.

    Without the ``repaired`` text, any Greek letter counts.
    """
    greek = c.rlike("[Ͱ-Ͽἀ-῿]") if repaired is None else c != repaired
    return F.struct(
        c.rlike(r"</?[A-Za-z][A-Za-z0-9_:.-]*[^>]*>").alias("xml"), greek.alias("greek"), c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]").alias("control"),
        c.rlike("\ufffd|[A-Za-zА-Яа-яЁё]-\n[A-Za-zА-Яа-яЁё]").alias("broken"),
    )
