"""Text normalisation, line predicates, tokens and stems as Column expressions (no UDF)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character sets and rules that decide results.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
SPACE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# White space other than line breaks, and runs of it that aren't one plain space.
_GAP = r"\t\x1F\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
GAPS = tuple(map(chr, [0x09, 0x1F, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
BREAKS = tuple(map(chr, [0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029]))
SPACES_BUT_PLAIN = r"\t-\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
UNEVEN_GAP = rf"[{_GAP} ]{{2,}}|[{_GAP}]"
ALEF_FORMS, TATWEEL = "إأآٱ", "ـ"
DIACRITICS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"
MARKS = "".join(map(chr, [*range(0x0610, 0x061B), *range(0x064B, 0x0660), 0x0670, *range(0x06D6, 0x06EE)]))
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
ARABIC = r"\x{0600}-\x{06FF}"
TOKEN = rf"\*[0-9]+(?:\*[0-9]+)*#|[\p{{L}}\p{{N}}_{ARABIC}]+"
NO_TOKEN, CODE = rf"[^\p{{L}}\p{{N}}_{ARABIC}]+", r"\*[0-9]+(?:\*[0-9]+)*#"
FEMININE_SUFFIXES = ("تها", "تهم", "تكم", "تنا", "تي", "تك")
POSSESSIVE_SUFFIXES = ("ها", "هم", "كم", "نا", "هن", "كن", "ي", "ك")
UI_LINES = (
    "home", "menu", "main menu", "main navigation", "navigation", "apps menu", "search", "submit", "apply", "cancel", "close", "open", "back", "next", "previous", "login", "log in", "logout", "log out", "sign in", "sign out", "register",
    "accessibility", "dark mode", "light mode", "font size", "share", "print", "download", "copy", "language", "switch", "account", "contact us", "contact us now", "useful links", "related links", "quick links", "more topics", "more services", "watch video",
    "الرئيسية", "الصفحة الرئيسية", "القائمة", "القائمة الرئيسية", "بحث", "البحث", "إرسال", "تأكيد", "إلغاء", "إغلاق", "رجوع", "التالي", "السابق", "تسجيل الدخول", "تسجيل خروج", "إنشاء حساب", "تواصل معنا", "اتصل بنا", "تغيير اللغة", "مشاركة", "طباعة", "تنزيل", "نسخ",
    "الحساب", "روابط مفيدة", "مواضيع ذات صلة", "روابط سريعة", "المزيد من الخدمات", "جميع الحقوق محفوظة",
)
ARTIFACT_LINES = ("a-", "a+", "switch", "accessibility", "dark mode", "light mode", "font size", "watch video", "image", "images", "icon", "icons", "breadcrumb", "breadcrumbs")
LINE_PATTERNS = (
    r"skip to (main )?content", r"skip to navigation", r"back to top", r"toggle (menu|navigation)", r"open (menu|navigation)", r"close (menu|navigation)", r"show (more|less)", r"load more", r"view (all|more)", r"read more", r"click here", r"learn more", r"go back",
    r"contact us", r"contact us (now|today).*", r"get in touch.*", r"need help.*", r"how can we help.*", r"we('re| are) here to help.*",
    r"(personal|business|corporate)", r"(products|services|offers|solutions)", r"(categories|category|topics)", r"(related links|useful links|quick links)", r"(more topics|more services)", r"(apps menu)",
)
DECORATIVE = rf"^[{SPACE[1:-1]}•◦▪▫●○■□◆◇★☆→←↑↓|/\\\-_=~*·]+$"
NUMBER_ONLY = r"^[0-9]{1,4}[.)]?$"
SHORT_LINE = 100


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x found once however often f uses it: expressions that stand in several branches are else evaluated in each."""
    return F.transform(F.array(x), lambda y: f(y))[0]


def strip(x: Column) -> Column:
    """Without white space (any Unicode kind) at the ends."""
    return F.btrim(x, F.lit(SPACES))


def lines(x: Column) -> Column:
    """The lines of a text; null has none."""
    return F.split(F.coalesce(x, F.lit("")), LINE_BREAK)


def even(x: Column) -> Column:
    """Every run of white space as one plain space; only runs that aren't one yet are rewritten."""
    return F.regexp_replace(x, rf"[{SPACES_BUT_PLAIN}]{SPACE}*| {SPACE}+", " ")


def _holds(x: Column, *parts: str) -> Column:
    """Whether a text holds one of these. Searches for strings take a fraction of the time of patterns, which then run on few texts."""
    found = F.lit(False)
    for p in parts:
        found = found | x.contains(p)
    return found


def has_arabic(x: Column) -> Column:
    return x.rlike(f"[{ARABIC}]")


def normalize_arabic(x: Column) -> Column:
    """One form of alef and haa, ASCII digits, no tatweel or diacritics; white space collapsed, blank lines dropped.

    All letters, digits and marks that change are in one block of Unicode, so texts without it skip these steps.
    """
    x = F.coalesce(x, F.lit(""))
    y = F.translate(x, ALEF_FORMS + "ة" + DIGITS_FROM + TATWEEL + MARKS, "ا" * len(ALEF_FORMS) + "ه" + DIGITS_TO)  # what has no counterpart goes
    x = F.when(has_arabic(x), y).otherwise(x)
    # Gaps within lines become one space, then line breaks with all that surrounds them become one break.
    x = once(x, lambda y: F.when(_holds(y, "  ", *GAPS), F.regexp_replace(y, UNEVEN_GAP, " ")).otherwise(y))
    ends = rf" +(?={LINE_BREAK}|$)|(?:{LINE_BREAK})(?: |{LINE_BREAK})+|[\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]"
    x = once(x, lambda y: F.when(_holds(y, " \n", "\n ", "\n\n", *BREAKS), F.regexp_replace(F.regexp_replace(y, ends, "\n"), r"\n{2,}", "\n")).otherwise(y))
    return F.btrim(x, F.lit(" \n"))


def normalize_line(x: Column) -> Column:
    """Plain spaces for no-break ones, no zero-width characters, runs of spaces and tabs collapsed, ends stripped."""
    return strip(_without_marks(x, "\u200b\ufeff"))


def _without_marks(x: Column, dropped: str) -> Column:
    x = F.replace(x, F.lit("\u00a0"), F.lit(" "))
    for c in dropped:
        x = F.replace(x, F.lit(c), F.lit(""))
    return F.regexp_replace(x, r"\t[ \t]*| [ \t]+", " ")


def normalized_lines(x: Column) -> Column:
    """The normalised lines of a text that aren't empty. What needs no line ends is done to the whole text at once."""
    return F.filter(F.transform(lines(_without_marks(F.coalesce(x, F.lit("")), "\u200b\ufeff")), strip), lambda line: line != "")


def n_words(x: Column) -> Column:
    """The number of runs of anything but spaces, tabs and line ends."""
    return F.size(F.array_remove(F.split(x, r"[ \t\r\n]+"), ""))


def key(x: Column) -> Column:
    """What lines are compared by: folded case, collapsed white space."""
    return F.replace(F.lower(even(strip(x))), F.lit("ß"), F.lit("ss"))


def is_boilerplate(line: Column, line_key: Column | None = None) -> Column:
    """User-interface, navigation, call-to-action, artifact, decorative and number-only lines; line_key is key(line) where it is at hand."""
    k = key(line) if line_key is None else line_key
    return k.isin(*UI_LINES, *ARTIFACT_LINES) | k.rlike("^(?:" + "|".join(LINE_PATTERNS) + ")$") | line.rlike(DECORATIVE) | line.rlike(NUMBER_ONLY)


def stem(token: Column) -> Column:
    """Light stem of a token of Arabic characters only: no article, no possessive suffix, three characters at least left."""
    bare = F.when(token.startswith("ال") & (F.length(token) >= 5), F.substring(token, F.lit(3), F.length(token))).otherwise(token)
    out, size = bare, F.length(bare)
    for s in reversed(POSSESSIVE_SUFFIXES):
        out = F.when(bare.endswith(s) & (size - len(s) >= 3), F.left(bare, size - len(s))).otherwise(out)
    for s in reversed(FEMININE_SUFFIXES):
        out = F.when(bare.endswith(s) & (size - len(s) >= 2), F.concat(F.left(bare, size - len(s)), F.lit("ه"))).otherwise(out)
    return F.when(token.rlike(f"^[{ARABIC}]+$"), out).otherwise(token)


def tokens(x: Column, stemmed: bool = True) -> Column:
    """Lower-cased tokens: short codes as they are, else runs of word and Arabic characters.

    Splitting takes time linear in the text, extracting all matches copies it for each; so only texts with a short code are extracted from.
    """

    def found(x: Column) -> Column:
        split = F.array_remove(F.split(x, NO_TOKEN), "")
        all_ = F.when(x.contains("*") & x.rlike(CODE), F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))).otherwise(split)
        return F.when(has_arabic(x), F.transform(all_, stem)).otherwise(all_) if stemmed else all_

    return once(F.lower(normalize_arabic(x)), found)


def _count(x: Column, kind: str) -> Column:
    """The number of characters of a class."""
    return F.length(F.regexp_replace(x, f"[^{kind}]+", ""))


def language(x: Column) -> Column:
    """ar where at least 0.3 of Arabic and Latin characters are Arabic, else en."""
    arabic, latin = F.when(has_arabic(x), _count(x, ARABIC)).otherwise(0), _count(x, "A-Za-z")
    return F.when(F.try_divide(arabic, arabic + latin) >= 0.3, "ar").otherwise("en")


# Letters of Arabic script, digits used as letters, function words.
ARABIC_LETTER = r"[\x{0621}-\x{063A}\x{0640}-\x{064A}\x{066E}\x{066F}\x{0671}-\x{06D3}\x{06D5}\x{06EE}\x{06EF}\x{06FA}-\x{06FF}]"
DIGIT_AS_LETTER = r"[a-zA-Z]+[23567890][a-zA-Z]*|[a-zA-Z]*[23567890][a-zA-Z]+"
FUNCTION_WORDS = "kif|shu|shou|leish|lesh|wein|fi|mnih|eno|ba3mal|3am|3ala|ktir|hala2|halla2|badde|biddi|mfeed|2diesh|adesh|kam|tab|yalla|sar|sarly"
FUNCTION_WORD = rf"(?i)\b({FUNCTION_WORDS})\b"


def is_arabizi(x: Column) -> Column:
    """Arabic written in Latin letters: no Arabic letter, three Latin ones, a digit used as a letter or a function word."""
    x = F.coalesce(x, F.lit(""))
    return ~x.rlike(ARABIC_LETTER) & (_count(x, "A-Za-z") >= 3) & (x.rlike(DIGIT_AS_LETTER) | x.rlike(FUNCTION_WORD))


def is_vague(x: Column) -> Column:
    """Shorter than three characters, without letters, or with a single distinct one."""
    x = F.coalesce(x, F.lit(""))
    letters = F.regexp_replace(x, r"\P{L}+", "")
    return (F.length(x) < 3) | (F.replace(letters, F.left(letters, F.lit(1)), F.lit("")) == "")


# ---- the same in DuckDB, for oracles


def sql_list(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_lines(x: str) -> str:
    return f"regexp_split_to_array(coalesce({x}, ''), '{LINE_BREAK}')"


def sql_normalize(x: str) -> str:
    x = f"replace(translate(translate(coalesce({x}, ''), '{ALEF_FORMS}', '{'ا' * 4}'), 'ة{DIGITS_FROM}', 'ه{DIGITS_TO}'), '{TATWEEL}', '')"
    x = f"regexp_replace({x}, '{DIACRITICS}', '', 'g')"
    each = sql_strip(f"regexp_replace(s, '{SPACE}+', ' ', 'g')")
    return f"array_to_string(list_filter(list_transform({sql_lines(x)}, lambda s: {each}), lambda s: s <> ''), chr(10))"


def sql_key(x: str) -> str:
    return f"replace(lower(regexp_replace({sql_strip(x)}, '{SPACE}+', ' ', 'g')), 'ß', 'ss')"


def sql_normalize_line(x: str) -> str:
    return sql_strip(rf"regexp_replace(replace(replace(replace({x}, chr(160), ' '), chr(8203), ''), chr(65279), ''), '[ \t]+', ' ', 'g')")


def sql_boilerplate(x: str) -> str:
    patterns = "|".join(LINE_PATTERNS).replace("'", "''")
    return f"({sql_key(x)} IN ({sql_list(UI_LINES + ARTIFACT_LINES)}) OR regexp_full_match({sql_key(x)}, '{patterns}') OR regexp_matches({x}, '{DECORATIVE}') OR regexp_matches({x}, '{NUMBER_ONLY}'))"


def sql_stem(t: str) -> str:
    bare = f"(CASE WHEN starts_with({t}, 'ال') AND length({t}) >= 5 THEN substr({t}, 3) ELSE {t} END)"
    cases = "".join(f" WHEN ends_with({bare}, '{s}') AND length({bare}) >= {len(s) + 2} THEN left({bare}, length({bare}) - {len(s)}) || 'ه'" for s in FEMININE_SUFFIXES)
    cases += "".join(f" WHEN ends_with({bare}, '{s}') AND length({bare}) >= {len(s) + 3} THEN left({bare}, length({bare}) - {len(s)})" for s in POSSESSIVE_SUFFIXES)
    return f"(CASE WHEN NOT regexp_full_match({t}, '[{ARABIC}]+') THEN {t}{cases} ELSE {bare} END)"


def sql_tokens(x: str, stemmed: bool = True) -> str:
    found = f"regexp_extract_all(lower({sql_normalize(x)}), '{TOKEN}')"
    return f"list_transform({found}, lambda t: {sql_stem('t')})" if stemmed else found
