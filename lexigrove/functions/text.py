"""Text normalisation and predicates as column expressions; null in, null out."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrove.config import CLAUSE, CYRILLIC_WORD, FURNITURE, LEADER, STOP_WORDS, TOKEN, URL, XML_NAME, XML_TAG, Settings

S = Settings()
_BLANKS = " \t\n\r\f\x0b"
#: Where a text breaks into lines.
BREAK = "\r\n|[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def once(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def lines(c: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(c, BREAK), strip), lambda x: x != "")


def normalize_whitespace(c: Column) -> Column:
    """No-break blanks to blanks, runs of blanks to one, lines trimmed at their ends, text trimmed."""
    c = F.regexp_replace(F.translate(c, "\u00a0", " "), "[ \t]+", " ")
    return strip(F.regexp_replace(c, " +\n", "\n"))


def join_hyphens(c: Column) -> Column:
    """Words broken at a line's end become whole."""
    c = F.regexp_replace(F.regexp_replace(c, "\u00ad", ""), "\r\n?", "\n")
    return F.regexp_replace(c, r"([A-Za-zА-Яа-яЁё])[ \t]*-[ \t]*\n[ \t]*([A-Za-zА-Яа-яЁё])", "$1$2")


def folded(c: Column) -> Column:
    """Lower case, ё as е, white space to one blank. Texts with Greek letters go through lookalike repair before."""
    # a single blank stays as it is, so only other white space is replaced
    return F.btrim(F.regexp_replace(F.translate(F.lower(c), "ё", "е"), r"[ \t\n\r\f\x0B]{2,}|[\t\n\r\f\x0B]", " "), F.lit(" "))


def tokens(c: Column) -> Column:
    return folded_tokens(folded(c))


def folded_tokens(c: Column) -> Column:
    """Tokens of a text that is folded already."""
    return F.filter(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(STOP_WORDS))


def clause_ids(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(CLAUSE), F.lit(0))


def is_code_token(t: Column) -> Column:
    return t.rlike(r"\p{L}") & t.rlike("[0-9]")


def is_furniture(line: Column) -> Column:
    return F.lower(line).rlike(FURNITURE)


def is_toc(c: Column) -> Column:
    """Contents page: enough lines, and enough of them with leaders."""
    ln = lines(c)
    n = F.size(F.filter(ln, lambda x: x.rlike(LEADER)))
    return (F.size(ln) >= S.toc_lines) & (n >= S.toc_leaders) & (n / F.size(ln) >= S.toc_share)


def is_mush(c: Column) -> Column:
    """Scraps of a diagram or torn table."""
    bare = (F.length(c) >= 200) & (F.regexp_count(c, F.lit("[.,;]")) * 1000 / F.length(c) < 2)

    def torn(sizes: Column) -> Column:
        n = F.size(sizes)
        short, scraps = F.size(F.filter(sizes, lambda x: x < 20)), F.size(F.filter(sizes, lambda x: x < 5))
        return (n >= 4) & ((short / n > 0.5) | (scraps / n > 0.3) | bare)

    return once(F.transform(lines(c), F.length), torn)


def is_xml_fragment(c: Column) -> Column:
    named = F.exists(F.regexp_extract_all(c, F.lit(XML_NAME), F.lit(1)), lambda x: F.length(x) >= 4)
    return named & (F.regexp_count(c, F.lit(CYRILLIC_WORD)) < 4)


def equation_lines(c: Column) -> Column:
    """Lines that are equations rather than sentences."""

    def equation(x: Column) -> Column:
        body = F.regexp_replace(x, URL, " ")
        compact = F.regexp_replace(body, r"[ \t\n\r\f\x0B]+", "")
        share = F.regexp_count(compact, F.lit(r"[0-9=∫∑∏√∂≤≥≠≈+*/^\[\](){}-]")) / F.length(compact)
        return ~body.rlike(CYRILLIC_WORD) & ~body.rlike("[A-Za-z]{12,}") & body.rlike("[=∫∑∏√∂≤≥≠≈]") & (F.length(compact) >= 10) & (share >= 0.35)

    return F.filter(lines(c), equation)


def is_formula_chunk(c: Column) -> Column:
    total = F.aggregate(equation_lines(c), F.lit(0), lambda a, x: a + F.length(x))
    return (total > 0) & (total >= 0.6 * F.length(c))


def is_garbage(c: Column) -> Column:
    """Tag dumps, bare links, tables of numbers, bare equations."""
    compact = F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", "")
    n, letters, digits = F.length(compact), F.regexp_count(compact, F.lit(r"\p{L}")), F.regexp_count(compact, F.lit("[0-9]"))
    link = c.rlike(URL) & (F.regexp_count(F.regexp_replace(c, URL, " "), F.lit(r"\p{L}")) < 40)
    long = (n >= 20) & ((letters == 0) | ((n - letters - digits) / n > 0.5) | (F.regexp_count(c, F.lit(XML_TAG)) >= 2) | link)
    return is_xml_fragment(c) | is_formula_chunk(c) | long


def script_shares(c: Column) -> Column:
    """(cyr, lat, greek) shares of the letters; zero without letters."""
    n = F.greatest(F.regexp_count(c, F.lit(r"\p{L}")), F.lit(1))
    return F.struct(*((F.regexp_count(c, F.lit(p)) / n).alias(k) for k, p in (("cyr", "[Ѐ-ӿ]"), ("lat", "[A-Za-z]"), ("greek", "[Ͱ-Ͽ]"))))


def lang_hint(c: Column) -> Column:
    cyr, lat = F.regexp_count(c, F.lit("[Ѐ-ӿ]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    share = cyr / (cyr + lat)
    return F.when(cyr + lat == 0, "unknown").when(share >= 0.6, "ru").when(share <= 0.2, "en").otherwise("mixed")


def density_score(chars: Column, area: Column) -> Column:
    """Characters per 1,000 square points, in bands; zero without area."""
    d = F.try_divide(chars, area / 1000)
    return F.when((chars == 0) | (area <= 0), 0.0).when(d < 0.3, 0.25).when(d < 2, 0.55).when(d <= 40, 1.0).when(d <= 80, 0.55).otherwise(0.15)


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of distinct words of three characters or more; 1 for two empty sets."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-zа-яё0-9]{3,}"), F.lit(0))) for c in (a, b))
    return F.when(F.size(F.array_union(x, y)) == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def reject_reason(page_class: Column, status: Column, low_confidence: Column, text: Column) -> Column:
    """First rule that keeps a page out of the index, else null."""
    t = F.coalesce(strip(text), F.lit(""))
    return (
        F.when(~F.coalesce(page_class.isin("A", "B"), F.lit(False)), "class")
        .when(~F.coalesce(status == "ok", F.lit(False)), "status")
        .when(F.coalesce(low_confidence, F.lit(False)), "low_confidence")
        .when(F.length(t) < S.min_chars, "short")
        .when(is_toc(t), "toc")
    )


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (structs x1, y1, x2, y2)."""
    w = F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    h = F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    area = lambda r: (r.x2 - r.x1) * (r.y2 - r.y1)
    return w * h / (area(a) + area(b) - w * h + 1e-9)
