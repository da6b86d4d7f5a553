"""Checks of whole values that rules name: domains, addresses, dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
DOMAIN = rf"^(?:{LABEL}\.)+[A-Za-z](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?$"
URL = rf"^(?:https?|ftps?|sftp|ssh|git|rtsp)://(?:[^\s:@/?#]+(?::[^\s:@/?#]*)?@)?(?:localhost|\d{{1,3}}(?:\.\d{{1,3}}){{3}}|\[[0-9A-Fa-f:.]+\]|(?:{LABEL}\.)+[A-Za-z](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?)(?::\d{{1,5}})?(?:[/?#]\S*)?$"
EMAIL = rf"^[A-Za-z0-9._%+-]+@(?:{LABEL}\.)+[A-Za-z]{{2,}}$"

LANGUAGE = r"^(?i)(?:[a-z]{2,3}(?:-[a-z]{3}){0,3}|[a-z]{4}|[a-z]{5,8})(?:-[a-z]{4})?(?:-(?:[a-z]{2}|\d{3}))?(?:-(?:[a-z0-9]{5,8}|\d[a-z0-9]{3}))*(?:-[0-9a-wy-z](?:-[a-z0-9]{2,8})+)*(?:-x(?:-[a-z0-9]{1,8})+)?$"


def asn(v: Column) -> Column:
    """A number of an autonomous system that may be announced: of 32 bits, not reserved (RFC 7607, 7300, 5398, 6996)."""
    n = F.regexp_replace(F.trim(v), "^(?i)AS", "").try_cast("bigint")
    kept = n.between(1, 23455) | n.between(23457, 64495) | n.between(131072, 4199999999)
    return F.coalesce(kept, F.lit(False))


CHECKS: dict[str, Callable[[Column], Column]] = {"domain": lambda v: v.rlike(DOMAIN), "url": lambda v: v.rlike(URL), "email": lambda v: v.rlike(EMAIL), "validate_asn": asn, "validate_language_tag": lambda v: v.rlike(LANGUAGE)}
#: Functions of names that rules may call; where a check of columns has no such twin, it is put to the name by Spark.
NAME_CHECKS: dict[str, Callable[[str], bool]] = {}


def holds(name: str, text: str) -> bool:
    """Whether a check holds for one text, such as a field's name."""
    if name in NAME_CHECKS:
        return bool(NAME_CHECKS[name](text))
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return bool(spark.range(1).select(F.coalesce(CHECKS[name](F.lit(text)), F.lit(False))).first()[0])

_M = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_RU = "(?:января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря)"
_FR = "(?:janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre)"
_D, _MM, _Y = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])", r"(?:1\d|20)\d\d"
_T = r"(?:[01]?\d|2[0-3]):[0-5]\d"

#: Key and pattern of the date layouts that are known, in the order they are tried.
DATE_PATTERNS: list[tuple[str, str]] = [
    ("iso_datetime_zone", rf"^{_Y}-{_MM}-{_D}[T ]{_T}:[0-5]\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)$"),
    ("iso_datetime", rf"^{_Y}-{_MM}-{_D}[T ]{_T}:[0-5]\d(?:\.\d+)?$"),
    ("iso_minutes", rf"^{_Y}-{_MM}-{_D}[T ]{_T}$"),
    ("iso_date", rf"^{_Y}-{_MM}-{_D}$"),
    ("ymd_slash", rf"^{_Y}/{_MM}/{_D}$"),
    ("ymd_dot", rf"^{_Y}\.{_MM}\.{_D}$"),
    ("dmy_dot_time", rf"^{_D}\.{_MM}\.{_Y} {_T}(?::[0-5]\d)?$"),
    ("dmy_dot", rf"^{_D}\.{_MM}\.{_Y}$"),
    ("dmy_dash", rf"^{_D}-{_MM}-{_Y}$"),
    ("mdy_slash", rf"^{_MM}/{_D}/{_Y}$"),
    ("dmy_slash", rf"^{_D}/{_MM}/{_Y}$"),
    ("slash_time", rf"^{_D}/{_D}/{_Y} {_T}(?::[0-5]\d)?$"),
    ("dmy_dot_short", rf"^{_D}\.{_MM}\.\d\d$"),
    ("d_month_y", rf"(?i)^{_D}[ -]{_M}\.?,?[ -]{_Y}$"),
    ("month_d_y", rf"(?i)^{_M}\.? {_D}(?:st|nd|rd|th)?,? {_Y}$"),
    ("d_month_y_ru", rf"(?i)^{_D} {_RU} {_Y}(?: г\.?)?$"),
    ("d_month_y_fr", rf"(?i)^{_D} {_FR} {_Y}$"),
    ("rfc822", rf"(?i)^(?:mon|tue|wed|thu|fri|sat|sun), {_D} {_M} {_Y} {_T}(?::[0-5]\d)?(?: \S+)?$"),
    ("month_y", rf"(?i)^{_M}\.?,? {_Y}$"),
]


_NAMES = {
    "en": _M,
    "ru": _RU,
    "fr": _FR,
    "ru_short": "(?:янв|фев|мар|апр|мая|май|июн|июл|авг|сен|сент|окт|ноя|нояб|дек)\\.?",
    "ru_alone": "(?:январь|февраль|март|апрель|май|июнь|июль|август|сентябрь|октябрь|ноябрь|декабрь)",
    "de": "(?:januar|jänner|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember)",
    "es": "(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre)",
    "it": "(?:gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre)",
    "pt": "(?:janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)",
    "bg": "(?:януари|февруари|март|април|май|юни|юли|август|септември|октомври|ноември|декември)",
    "cz": "(?:ledna|února|března|dubna|května|června|července|srpna|září|října|listopadu|prosince)",
}
_DAYS = r"(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?|(?:понедельник|вторник|среда|четверг|пятница|суббота|воскресенье),?"
_CLOCKS = {"": "", "_minutes": rf"[T ,]+{_T}", "_seconds": rf"[T ,]+{_T}:[0-5]\d(?:[.,]\d+)?(?: ?(?:Z|UTC|GMT|[+-]\d\d:?\d\d))?", "_ampm": r" +(?:0?[1-9]|1[0-2]):[0-5]\d(?::[0-5]\d)? ?[APap]\.?[Mm]\.?"}


def _layouts() -> list[tuple[str, str]]:
    """Layouts by rule: an order of day, month and year, signs between them, names of months, and a time after it."""
    known = {p for _, p in DATE_PATTERNS}
    out: list[tuple[str, str]] = []

    def add(key: str, body: str, caseless: bool = False) -> None:
        for clock, tail in _CLOCKS.items():
            pattern = f"{'(?i)' if caseless else ''}^{body}{tail}$"
            if pattern not in known:
                out.append((key + clock, pattern))

    for name, sign in (("dash", "-"), ("slash", "/"), ("dot", r"\."), ("space", " ")):
        add(f"ymd_{name}_any", sign.join((_Y, _MM, _D)))
        add(f"dmy_{name}_any", sign.join((_D, _MM, _Y)))
        add(f"mdy_{name}_any", sign.join((_MM, _D, _Y)))
        add(f"dmy_{name}_short", sign.join((_D, _MM, r"\d\d")))
        add(f"mdy_{name}_short", sign.join((_MM, _D, r"\d\d")))
        add(f"ym_{name}", sign.join((_Y, _MM)))
        add(f"my_{name}", sign.join((_MM, _Y)))
    add("ymd_compact", r"(?:1\d|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])")
    for lang, months in _NAMES.items():
        add(f"d_month_y_{lang}_any", rf"(?:(?:{_DAYS}) +)?{_D}(?:st|nd|rd|th|er|\.)?(?: de|[ .-])? ?{months}\.?,?(?: de|[ -])? ?{_Y}(?: ?(?:г\.?|года))?", True)
        add(f"month_d_y_{lang}", rf"(?:(?:{_DAYS}) +)?{months}\.? +{_D}(?:st|nd|rd|th)?,? +{_Y}", True)
        add(f"y_month_d_{lang}", rf"{_Y}[ -]{months}[ -]{_D}", True)
        add(f"month_y_{lang}_any", rf"{months}\.?,?(?: de)? +{_Y}(?: ?(?:г\.?|года))?", True)
        add(f"d_month_short_{lang}", rf"{_D}[ -]{months}[ -]\d\d", True)
    out += [("iso_week", rf"^{_Y}-W(?:0[1-9]|[1-4]\d|5[0-3])(?:-[1-7])?$"), ("ordinal", rf"^{_Y}-(?:[0-2]\d\d|3[0-6]\d)$"), ("ctime", rf"(?i)^(?:mon|tue|wed|thu|fri|sat|sun) {_M} +{_D} {_T}:[0-5]\d(?: [A-Z]{{3,4}})? {_Y}$")]
    return out


DATE_PATTERNS += _layouts()
#: Most texts are no dates: one look at their beginning spares the others.
MAYBE_DATE = r"(?i)^(?=.{6,60}$)(?:\d{1,4}[\p{L}\s./,-]|\d{8}(?:\D|$)|\p{L}{3,12}[.,]?\s)"


def date_pattern(v: Column) -> Column:
    """The key of the first layout that the text has, or null."""
    out = None
    for key, pattern in DATE_PATTERNS:
        out = F.when(v.rlike(pattern), key) if out is None else out.when(v.rlike(pattern), key)
    return F.when(v.rlike(MAYBE_DATE), out)
