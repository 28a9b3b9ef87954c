"""Languages, scripts, fonts and visual lengths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.arrays import let
from textloom.functions.text import collapse, strip

# Names of languages and locales by internal code.
ALIASES: dict[str, tuple[str, ...]] = {
    "zh-CN": ("zh", "zh-cn", "zh_cn", "zh-hans", "zh_hans", "chinese", "中文", "简体中文", "簡體中文"),
    "zh-TW": (
        "zh-tw", "zh_tw", "zh-hant", "zh_hant", "繁体中文台湾", "繁體中文台灣", "繁体中文（台湾）", "繁體中文（台灣）",
        "traditional chinese taiwan", "traditional chinese (taiwan)",
    ),
    "zh-HK": (
        "zh-hk", "zh_hk", "繁体中文香港", "繁體中文香港", "繁体中文（香港）", "繁體中文（香港）",
        "traditional chinese hong kong", "traditional chinese (hong kong)",
    ),
    "en": ("english", "英语"),
    "fr": ("french", "francais", "français", "法语", "法文"),
    "de": ("german", "deutsch", "德语", "德文"),
    "es": ("spanish", "español", "espanol", "西班牙语", "西班牙文"),
    "ru": ("russian", "русский", "俄语", "俄文"),
    "ja": ("japanese", "日语", "日文"),
    "ko": ("korean", "韩语", "韩文"),
    "bn": ("bengali", "孟加拉语", "孟加拉文"),
    "km": ("khmer", "cambodian", "高棉语", "高棉文", "柬埔寨语", "柬埔寨文"),
    "vi": ("vietnamese", "越南语", "越南文"),
}

# The font of each target language.
FALLBACK_FONTS = {
    "zh-CN": "Noto Sans SC", "zh-TW": "Noto Sans TC", "zh-HK": "Noto Sans HK", "en": "Calibri", "fr": "Calibri",
    "de": "Calibri", "es": "Calibri", "ru": "Calibri", "ja": "Yu Gothic", "ko": "Malgun Gothic", "bn": "Nirmala UI",
    "km": "Khmer UI", "vi": "Calibri",
}
# Parts of the names of symbol fonts, of fonts with few Latin letters, and of the fonts of each script.
SYMBOL_FONTS = ("wingdings", "webdings", "symbol")
LIMITED_LATIN_FONTS = (
    "simsun", "simhei", "fangsong", "kaiti", "dengxian", "microsoft yahei", "msyh", "heiti", "songti", "noto sans sc",
    "source han sans", "noto serif sc", "ms mincho", "ms gothic", "meiryo", "hiragino", "yu gothic", "noto sans jp",
    "malgun", "gulim", "batang", "dotum", "noto sans kr",
)
SCRIPT_FONTS = {
    "zh-CN": (
        "simsun", "宋体", "simhei", "黑体", "fangsong", "仿宋", "kaiti", "楷体", "dengxian", "等线", "microsoft yahei",
        "微软雅黑", "songti sc", "pingfang sc", "heiti sc", "stfangsong", "stkaiti", "stheiti", "stsong", "noto sans sc",
        "noto serif sc", "noto sans cjk sc", "noto serif cjk sc", "source han sans sc", "source han serif sc", "思源黑体",
        "思源宋体", "arial unicode ms",
    ),
    "zh-TW": (
        "pmingliu", "mingliu", "新細明體", "細明體", "microsoft jhenghei", "微軟正黑體", "songti tc", "pingfang tc",
        "heiti tc", "noto sans tc", "noto serif tc", "noto sans cjk tc", "noto serif cjk tc", "source han sans tc",
        "source han serif tc", "arial unicode ms",
    ),
    "zh-HK": (
        "mingliu_hkscs", "mingliu hkscs", "pingfang hk", "noto sans hk", "noto serif hk", "noto sans cjk hk",
        "noto serif cjk hk", "source han sans hk", "source han serif hk", "arial unicode ms",
    ),
    "ja": (
        "yu gothic", "yu mincho", "meiryo", "ms gothic", "ms mincho", "hiragino", "osaka", "noto sans jp",
        "noto serif jp", "noto sans cjk jp", "noto serif cjk jp", "source han sans jp", "source han serif jp",
        "游ゴシック", "游明朝", "メイリオ", "arial unicode ms",
    ),
    "ko": (
        "malgun", "gulim", "batang", "dotum", "apple sd gothic", "applemyungjo", "noto sans kr", "noto serif kr",
        "noto sans cjk kr", "noto serif cjk kr", "source han sans kr", "source han serif kr", "맑은 고딕", "굴림", "바탕",
        "돋움", "arial unicode ms",
    ),
    "bn": ("nirmala ui", "vrinda", "noto sans bengali", "solaimanlipi"),
    "km": ("khmer ui", "daunpenh", "noto sans khmer"),
}

# Scripts as character classes, in the order in which they are tried.
SCRIPTS: tuple[tuple[str, str], ...] = (
    ("common", r"\s\x{1c}-\x{1f}\x{20}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7E}\x{2000}-\x{206F}"),
    ("zh", r"\x{2500}-\x{259F}"),
    (
        "math",
        r"\x{370}-\x{3FF}\x{1F00}-\x{1FFF}\x{2070}-\x{209F}\x{2100}-\x{214F}\x{2190}-\x{23FF}\x{27C0}-\x{27FF}"
        r"\x{2900}-\x{2BFF}\x{1D400}-\x{1D7FF}",
    ),
    ("ru", r"\x{400}-\x{52F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}\x{1C80}-\x{1C8F}"),
    ("vi", r"ĂăÂâÊêÔôƠơƯưĐđ\x{1E00}-\x{1EFF}\x{20AB}"),
    ("bn", r"\x{980}-\x{9FF}"),
    ("km", r"\x{1780}-\x{17FF}\x{19E0}-\x{19FF}"),
    (
        "ko",
        r"\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{AC00}-\x{D7A3}\x{D7B0}-\x{D7FF}\x{3200}-\x{321E}"
        r"\x{3260}-\x{327F}\x{FFA0}-\x{FFDC}",
    ),
    ("ja", r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9D}\x{32D0}-\x{32FE}"),
    (
        "zh",
        r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}\x{30000}-\x{323AF}"
        r"\x{3000}-\x{303F}\x{FF00}-\x{FFEF}",
    ),
)
# Order of the greedy choice, and of equal counts.
GREEDY = ("vi", "km", "bn", "ru", "ko", "ja", "zh")
RANKED = ("zh", "en", "ru", "ja", "ko", "bn", "km", "vi")


def language_code(name: Column) -> Column:
    """Internal code of a language name, else the lower-cased name (O-39)."""
    plain = F.lower(strip(F.coalesce(name, F.lit(""))))
    table = F.create_map(*[F.lit(x) for code, names in ALIASES.items() for n in names for x in (n, code)])
    return F.coalesce(F.try_element_at(table, plain), plain)


def script_of(char: Column) -> Column:
    """Script of one character (O-42)."""
    out = F.lit("en")
    for name, chars in reversed(SCRIPTS):
        out = F.when(char.rlike(f"(?U)^[{chars}]$"), name).otherwise(out)
    return out


def script_counts(text: Column) -> dict[str, Column]:
    """Letters and digits of each script; every class excludes those before it."""
    # ASCII first, by a cheap class: its letters are Latin, its digits common to all scripts.
    ascii_letters = F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z]+", ""))
    rest = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x7F]+", ""), r"[^\p{L}\p{N}]", "")
    counts: dict[str, Column] = {}
    for name, chars in SCRIPTS:
        less = F.regexp_replace(rest, f"[{chars}]", "")
        counts[name] = counts.get(name, F.lit(0)) + F.length(rest) - F.length(less)
        rest = less
    counts["en"] = F.length(rest) + ascii_letters
    return counts


def infer_language(text: Column, mode: str = "greedy") -> Column:
    """Language of a text by its scripts (O-43)."""
    empty = F.regexp_replace(text, "[\r\n]", "") == ""
    counts = script_counts(text)
    if mode == "greedy":
        out = F.lit("en")
        for name in reversed(GREEDY):
            out = F.when(counts[name] > 0, name).otherwise(out)
        return F.when(empty, "zh").otherwise(out)
    most = F.greatest(*[counts[n] for n in RANKED])
    first = F.coalesce(*[F.when(counts[n] == most, n) for n in RANKED])
    total = F.greatest(reduce(lambda a, b: a + b, [counts[n] for n in RANKED]), F.lit(1))
    strong = F.coalesce(*[F.when(counts[n] / total > 0.1, n) for n in ("zh", "ja", "ko", "ru", "bn", "km", "vi")])
    return F.when(empty, "zh").when(first != "en", first).otherwise(F.coalesce(strong, F.lit("en")))


# Characters of the scripts of office texts.
_CHINESE = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2CEAF}\x{30000}-\x{3134F}]"
_LATIN = r"[A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}]"
_CYRILLIC = r"[\x{400}-\x{52F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}]"


def script_slot(language: Column, text: Column) -> Column:
    """Office script slot to check for a translated text, or null (O-45)."""
    code = language_code(language)
    has = lambda pattern: text.rlike(pattern)
    slot = (
        F.when(code.isin("zh-CN", "zh-TW", "zh-HK") & has(_CHINESE), "east_asian")
        .when((code == "ja") & (has(r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}]") | has(_CHINESE)), "east_asian")
        .when((code == "ko") & (has(r"[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}]") | has(_CHINESE)), "east_asian")
        .when((code == "ru") & has(_CYRILLIC), "latin")
        .when(code.isin("en", "fr", "de", "es", "vi") & has(_LATIN), "latin")
        .when((code == "bn") & has(r"[\x{980}-\x{9FF}]"), "complex_script")
        .when((code == "km") & has(r"[\x{1780}-\x{17FF}\x{19E0}-\x{19FF}]"), "complex_script")
    )
    return F.when(strip(text) != "", slot)


def fallback_font(language: Column, text: Column, font: Column) -> Column:
    """Font to write where the current one does not cover the text, or null (O-46)."""
    code, slot = language_code(language), script_slot(language, text)
    preset = F.try_element_at(F.create_map(*[F.lit(x) for pair in FALLBACK_FONTS.items() for x in pair]), code)
    name = F.lower(strip(F.coalesce(font, F.lit(""))))
    any_of = lambda parts: reduce(lambda a, b: a | b, [F.contains(name, F.lit(p)) for p in parts])
    extended = text.rlike(r"[\x{C0}-\x{24F}\x{1E00}-\x{1EFF}]") | text.rlike(_CYRILLIC)
    latin = (name == "") | any_of(SYMBOL_FONTS) | (extended & any_of(LIMITED_LATIN_FONTS))
    known = reduce(lambda a, b: a | b, [(code == k) & any_of(v) for k, v in SCRIPT_FONTS.items()])
    needs = F.when(slot == "latin", latin).otherwise(~known)
    return F.when(slot.isNotNull() & needs, preset)


def unchanged_needs_retry(source: Column, translated: Column, source_language: Column, target_language: Column) -> Column:
    """Whether an unchanged translation surely misses something (O-38)."""

    def visible(text: Column) -> Column:
        text = F.regexp_replace(text, r"(?i)\[(?:PARA|SLIDE|SHAPE|TABLE|CELL|ROW|NOTE|HEADER|FOOTER)[^\]]*\]", " ")
        return strip(F.regexp_replace(F.regexp_replace(text, r"(?i)</?(?:span|p)>", " "), r"⟪PF_[^⟫]+⟫", " "))

    code, target = language_code(source_language), language_code(target_language)

    def of_seen(seen: Column) -> Column:
        cjk = F.regexp_count(seen, F.lit(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"))
        words = F.regexp_count(seen, F.lit("[A-Za-z]{2,}"))
        missed = (
            F.when(target.isin("zh-CN", "zh-TW", "zh-HK"), (cjk == 0) & (words >= 2))
            .when(target == "en", cjk >= 2)
            .otherwise((code == "en") & target.isin("fr", "de", "es", "ru", "vi") & (words >= 2))
        )
        # Texts that are equal as they stand are so as they are seen.
        same = (seen != "") & F.when(source == translated, F.lit(True)).otherwise(collapse(seen) == collapse(visible(translated)))
        return same & ~((code != "") & (code == target)) & missed

    return let(visible(source), of_seen)


# Width of characters, in the order in which the classes are tried.
PAGE_WIDTHS: tuple[tuple[str, float], ...] = (
    (r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}\x{30000}-\x{3134F}", 1.0),
    (r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}", 1.0),
    (r"\x{FF66}-\x{FF9D}", 0.5),
    (r"\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{AC00}-\x{D7A3}\x{D7B0}-\x{D7FF}", 1.0),
    (r"\x{400}-\x{52F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}\x{1C80}-\x{1C8F}", 0.58),
    (r"\x{980}-\x{9FF}", 0.6),
    (r"\x{1780}-\x{17FF}\x{19E0}-\x{19FF}", 0.7),
    (r"A-Za-z0-9\x{C0}-\x{24F}\x{1E00}-\x{1EFF}", 0.52),
    (r"\x{20}", 0.25),
    (r"\x{3000}\x{FF01}-\x{FF5E}", 1.0),
    (r"\x{3001}-\x{303F}\x{FF5F}-\x{FF65}\x{FF9E}-\x{FFEF}", 0.8),
    (r"\x{21}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7E}", 0.3),
)
SLIDE_WIDTHS: tuple[tuple[str, float], ...] = (
    (r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}", 1.8),
    (r"A-Z", 1.15),
    (r"a-z", 1.0),
    (r"0-9", 0.9),
    (r"\s,.;:!?()\[\]{}\-–—\"'", 0.4),
)


def visual_length(text: Column, widths: tuple[tuple[str, float], ...], default: float = 1.0) -> Column:
    """Sum of character widths (O-47 with PAGE_WIDTHS, O-48 with SLIDE_WIDTHS); six decimals."""
    rest, total = text, F.lit(0.0)
    for chars, width in widths:
        less = F.regexp_replace(rest, f"(?U)[{chars}]", "")
        total = total + (F.length(rest) - F.length(less)) * width
        rest = less
    return F.round(total + F.length(rest) * default, 6)


def shrunk_size(size: Column, original: Column, translated: Column) -> Column:
    """Slide font size for a longer translation: never below 8 points or three quarters (O-113)."""
    scale = F.greatest(
        F.greatest(8.0 / F.greatest(size, F.lit(1e-6)), F.lit(0.75)), F.least(F.lit(1.0), F.sqrt(original / translated))
    )
    new = F.greatest(F.lit(8.0), F.bround(size * scale))
    return F.when((original < 1) | (translated <= original) | (new >= size), size).otherwise(new)


def adjusted_size(size: Column, original: Column, translated: Column, least_ratio: float = 0.4, least: float = 6.0) -> Column:
    """Page font size by the growth of the text, with adaptive floors (O-151)."""
    growth = translated / original
    floor_ = (
        F.when(growth <= 2, least_ratio).when(growth >= 4, 0.25).when(growth >= 3, 0.30).when(growth >= 2.5, 0.35).otherwise(0.38)
    )
    fitted = F.greatest(size * original / translated, F.greatest(size * floor_, F.lit(least)))
    return F.when((original <= 0) | (translated <= original), size).otherwise(fitted)


# Names of languages in prompts, by lower-cased code.
TARGET_LABELS = {
    "zh": "Simplified Chinese", "zh-cn": "Simplified Chinese", "zh-tw": "Traditional Chinese (Taiwan)",
    "zh-hk": "Traditional Chinese (Hong Kong)", "en": "English", "fr": "French", "de": "German", "es": "Spanish", "ru": "Russian",
    "ja": "Japanese", "ko": "Korean", "vi": "Vietnamese",
}


def target_label(language: Column) -> Column:
    """Name of a target language, else the code as given (O-40)."""
    code = F.replace(F.lower(F.trim(language)), F.lit("_"), F.lit("-"))
    table = F.create_map(*[F.lit(x) for pair in TARGET_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.trim(language))


def source_label(language: Column) -> Column:
    """Name of a source language; all kinds of Chinese are one (O-40)."""
    given = F.coalesce(language, F.lit("auto"))
    code = F.replace(F.lower(F.trim(given)), F.lit("_"), F.lit("-"))
    chinese = code.isin("zh", "zh-cn", "zh-tw", "zh-hk")
    return F.when(code == "auto", "automatically identified language").when(chinese, "Chinese").otherwise(target_label(given))


def nearly_identical(a: Column, b: Column) -> Column:
    """Equal but for white space and case (O-156)."""
    plain = lambda t: F.lower(F.regexp_replace(t, r"(?U)\s+", ""))
    return plain(a) == plain(b)


def span_text(text: Column) -> Column:
    """Without soft hyphens, white space collapsed (O-148)."""
    return collapse(F.replace(text, F.lit("­"), F.lit("")))


def _run_pattern() -> str:
    """A pattern whose matches are the runs of a text: a character of a script with those of the same script or common to
    all after it; common ones alone can only begin a text. Each class leaves out those before it."""
    own: dict[str, str] = {}
    before = ""
    for name, chars in SCRIPTS:
        own[name] = own.get(name, "") + (f"[[{chars}]&&[^{before}]]" if before else f"[{chars}]")
        before += chars
    own["en"] = own.get("en", "") + f"[^{before}]"
    common = own.pop("common")
    return "(?U)" + "|".join(f"[{chars}][{chars}{common}]*+" for chars in own.values()) + f"|[{common}]++"


def script_runs(text: Column, default: str = "en") -> Column:
    """Maximal runs of one script as (text, script); characters common to all stay with the run, those that begin the text
    with the default (O-28). One pass of a pattern, linear in the text."""
    runs = F.regexp_extract_all(text, F.lit(_run_pattern()), F.lit(0))
    named = F.transform(runs, lambda r: F.struct(r.alias("text"), F.nullif(script_of(F.left(r, F.lit(1))), F.lit("common")).alias("script")))

    def settled(all_: Column) -> Column:
        first, second = F.get(all_, F.lit(0)), F.get(all_, F.lit(1))
        joined = F.struct(F.concat(first["text"], second["text"]).alias("text"), second["script"].alias("script"))
        joins = first["script"].isNull() & (second["script"] == default)
        rest = F.when(joins, F.concat(F.array(joined), F.slice(all_, 3, F.greatest(F.size(all_) - 2, F.lit(0))))).otherwise(all_)
        return F.transform(rest, lambda r: F.struct(r["text"].alias("text"), F.coalesce(r["script"], F.lit(default)).alias("script")))

    return let(named, settled)


# Names of target languages and the fonts' language that serves them; others have zh.
FONT_LANGUAGES = {
    "zh": ("中文", "简体中文", "chinese", "simplified chinese", "zh", "zh-cn", "zh_cn"),
    "zh-tw": ("繁体中文", "繁體中文", "繁体中文（台湾）", "繁體中文（台灣）", "traditional chinese", "traditional chinese (taiwan)", "zh-tw", "zh_tw"),
    "zh-hk": ("繁体中文（香港）", "繁體中文（香港）", "traditional chinese (hong kong)", "zh-hk", "zh_hk"),
    "ja": ("日文", "日语", "japanese", "ja"),
    "ko": ("韩文", "韩语", "korean", "ko"),
    "en": (
        "英文", "英语", "english", "en", "法文", "法语", "french", "fr", "德文", "德语", "german", "de", "西班牙文", "西班牙语", "spanish", "es",
    ),
    "ru": ("俄文", "俄语", "russian", "ru"),
    "bn": ("孟加拉语", "孟加拉文", "bengali", "bn"),
    "km": ("柬埔寨语", "柬埔寨文", "高棉语", "khmer", "km"),
    "vi": ("越南语", "越南文", "vietnamese", "vi"),
}


def font_language(name: Column) -> Column:
    """The fonts' language of a target language's name (O-44)."""
    plain, out = strip(F.lower(name)), F.lit("zh")
    for code, names in FONT_LANGUAGES.items():
        out = F.when(plain.isin(*names), code).otherwise(out)
    return out
