"""Human-written dates, numbers and booleans to their normal forms, as column expressions.

``transform(col, name, registry)`` gives the normal form, or NULL where the text doesn't fit the format; nothing
raises in the middle of a job. ``errors`` marks texts that don't fit. Registries one to four add up as published:
the third holds the second, the fourth replaces names by longer ones.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beginnings of month names by language, January to December, alternatives divided by a bar.
MONTHS = {
    "bg": "ян фев мар апр май|маи юни юли авг сеп окт ное дек",
    "cs": "led úno|uno bře|bre dub kvě|kve čvn|cvn čvc|cvc srp zář|zar říj|rij lis pro",
    "da": "jan feb mar apr maj jun jul aug sep okt nov dec",
    "de": "jan|jän|jaen feb mär|maer|mar apr mai jun jul aug sep okt nov dez",
    "el": "ιαν|ίαν|iαν φεβ μάρ|μαρ απρ|άπρ|aπρ|αρίλ|άρίλ|αριλ|άριλ|aρίλ|aριλ μαΐ|μαι|μάι|μαϊ|μάϊ ιούν|ίούν|ίουν|ιουν|iούν|iουν ιούλ|ίούλ|ίουλ|ιουλ|iούλ|iουλ αύγ|αυγ σεπ οκτ|όκτ|oκτ νοέ|νοε δεκ",
    "en": "january|jan february|feb march|mar april|apr may june|jun july|jul august|aug september|sep october|oct november|nov december|dec",
    "es": "ene feb mar abr may jun jul ago sep oct nov dic",
    "et": "jaan veebr märts|marts apr mai juuni juuli aug sept okt nov dets",
    "fi": "tam hel maa huh tou kes hei elo syy lok mar jou",
    "fr": "janv févr|fevr mars avr mai juin juil août|aout sept oct nov déc|dec",
    "hr": "sij velj ožu|ozu tra svi lip srp kol ruj lis stu pro",
    "hu": "jan feb márc|marc ápr|apr máj|maj jún|jun júl|jul aug szept okt nov dec",
    "it": "gen feb mar apr mag giu lug ago set ott nov dic",
    "lt": "sau vas kov bal geg bir lie rugp|rgp rugs|rgs spa|spl lap gru|grd",
    "lv": "janv febr marts apr maijs jūn|jun jūl|jul aug sept okt nov dec",
    "nl": "jan feb maa|mrt apr mei jun jul aug sep okt nov dec",
    "no": "jan feb mar apr mai jun jul aug sep okt nov des",
    "pl": "sty lut mar kwi maj cze lip sie wrz paź|paz lis gru",
    "pt": "jan fev mar abr mai jun jul ago set out nov dez",
    "ro": "ian feb mar apr mai iun iul aug sep oct noi|nov dec",
    "se": "jan feb mar apr máj|maj jún|jun júl|jul aug sep okt nov dec",
    "sk": "jan feb mar apr máj|maj jún|jun júl|jul aug sep okt nov dec",
    "sl": "jan feb mar apr maj jun jul avg sep okt nov dec",
    "hi": "जनवरी फरवरी|फ़रवरी मार्च अप्रैल मई जून जुलाई अगस्त सितंबर|सितम्बर अक्टूबर|अक्तूबर नवंबर|नवम्बर दिसंबर|दिसम्बर",
}
#: Czech names are whole words, after a day in one case, with a year alone in three.
CZECH_DAY = "ledna února|unora března|brezna dubna května|kvetna června|cervna července|cervence srpna září|zari října|rijna listopadu prosince"
CZECH_MONTH = "leden|ledna|lednu únor|unor|února|unora|únoru|unoru březen|brezen|března|brezna|březnu|breznu duben|dubna|dubnu květen|kveten|května|kvetna|květnu|kvetnu červen|cerven|června|cervna|červnu|cervnu červenec|cervenec|července|cervence|červenci|cervenci srpen|srpna|srpnu září|zari říjen|rijen|října|rijna|říjnu|rijnu listopad|listopadu prosinec|prosince|prosinci"
LONG_EN = "January February March April May June July August September October November December".split()
SHORT_EN = [m[:3] for m in LONG_EN]
ROMAN = "I II III IV V VI VII VIII IX X XI XII".split()
#: Japanese eras and the year before their first.
ERAS = {"令和": 2018, "令": 2018, "平成": 1988, "平": 1988, "昭和": 1925, "昭": 1925, "大正": 1911, "大": 1911, "明治": 1867, "明": 1867}
#: Months of the Indian national calendar with days and Gregorian start (month, day, years later).
SAKA_MONTHS = ["चैत्र", "वैशाख|बैसाख", "ज्येष्ठ", "आषाढ", "श्रावण|सावन", "भाद्रपद|भादो", "आश्विन", "कार्तिक", "मार्गशीर्ष|अगहन", "पौष", "माघ", "फाल्गुन"]
SAKA_LATIN = ["C\\S*ait\\S*", "Vai\\S*", "Jy\\S*", "\\S*[dḍ]ha", "\\S*vana|Śrāvaṇa", "Bh\\S+dra\\S*|Proṣṭhapada", "\\S+in", "K\\S+rti\\S*", "M\\S+rga\\S*|Agra\\S*", "Pau\\S*", "M\\S+gh\\S*", "Ph\\S+lg\\S*"]
SAKA_LENGTH = [30, 31, 31, 31, 31, 31, 30, 30, 30, 30, 30, 30]
SAKA_START = [(3, 22, 0), (4, 21, 0), (5, 22, 0), (6, 22, 0), (7, 23, 0), (8, 23, 0), (9, 23, 0), (10, 23, 0), (11, 22, 0), (12, 22, 0), (1, 21, 1), (2, 20, 1)]

EDGE = r"[ \t\n\r]*"
DAY, YEAR, GAP = r"([0-9]{1,2})", r"([0-9]{4}|[0-9]{1,2})", r"[^0-9]+"
NBSP = " "
WIDE_DIGITS = ("０１２３４５６７８９", "0123456789")
DEVANAGARI = ("०१२३४५६७८९", "0123456789")


def _group(c: Column, pattern: str, i: int) -> Column:
    """A group of the pattern; NULL where nothing matches."""
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


MARK = "\x1f"


def _fields(c: Column, pattern: str, groups: tuple[int, ...], build) -> Column:
    """``build`` of groups of a pattern that spans the whole text, matched once a row; NULL where it doesn't match."""
    found = F.split(F.regexp_replace(F.translate(c, MARK, " "), pattern, MARK.join(f"${i}" for i in groups)), MARK)
    field = lambda parts, i: F.nullif(F.element_at(parts, i + 1), F.lit(""))
    return _once(found, lambda parts: F.when(F.size(parts) == len(groups), build(*[field(parts, i) for i in range(len(groups))])))


def _once(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _last_day(month: Column, year: Column | None = None) -> Column:
    leap = F.lit(True) if year is None else (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).when(month.between(1, 12), 31)


def _two(c: Column) -> Column:
    return F.lpad(c.try_cast("int").cast("string"), 2, "0")


def year4(y: Column) -> Column:
    """Short years take their first digits from 2000."""
    return F.when(F.length(y) >= 4, y).otherwise(F.concat(F.substring(F.lit("2000"), F.lit(1), 4 - F.length(y)), y))


def _month_table(names: list[tuple[str, int]]) -> Column:
    return F.create_map(*[F.lit(x) for name, n in names for x in (name, n)])


def _named(language: str, shape: str = "") -> tuple[str, list[tuple[str, int]]]:
    """Pattern of the month names of a language and what they mean, longer names first."""
    lists = [MONTHS[language]] + ([CZECH_MONTH if shape == "my" else CZECH_DAY] if language == "cs" else [])
    names = [(name, n) for each in lists for n, group in enumerate(each.split(), 1) for name in group.split("|")]
    names.sort(key=lambda x: -len(x[0]))
    return "(" + "|".join(n for n, _ in names) + ")", names


def _month(text: Column, names) -> Column:
    return F.try_element_at(_month_table(names), F.lower(text)) if names else text.try_cast("int")


def _date(c: Column, pattern: str, day: int, month: int, year: int, names=None, clean=None) -> Column:
    def build(d: Column, m: Column, y: Column) -> Column:
        return _valid_date(year4(y), _month(m, names), d.try_cast("int"))

    return _fields(clean(c) if clean else c, pattern, (day, month, year), build)


def _valid_date(y: Column, m: Column, d: Column) -> Column:
    def build(v: Column) -> Column:
        n = v["y"].try_cast("int")
        return F.when((n >= 1) & (v["d"] >= 1) & (v["d"] <= _last_day(v["m"], n)), F.concat_ws("-", v["y"], _two(v["m"]), _two(v["d"])))

    return _once(F.struct(y.alias("y"), m.alias("m"), d.alias("d")), build)


def _month_day(c: Column, pattern: str, day: int, month: int, names=None) -> Column:
    def build(d: Column, m: Column) -> Column:
        d = d.try_cast("int")
        return _once(_month(m, names), lambda m: F.when((d >= 1) & (d <= _last_day(m)), F.concat(F.lit("--"), _two(m), F.lit("-"), _two(d))))

    return _fields(c, pattern, (day, month), build)


def _year_month(c: Column, pattern: str, month: int, year: int, names=None, clean=None) -> Column:
    def build(m: Column, y: Column) -> Column:
        return _once(_month(m, names), lambda m: F.when(m.between(1, 12) & y.isNotNull(), F.concat_ws("-", year4(y), _two(m))))

    return _fields(clean(c) if clean else c, pattern, (month, year), build)


def _whole(body: str, flags: str = "") -> str:
    return f"{flags}^{EDGE}{body}{EDGE}$"


def _number(c: Column, pattern: str, drop: str, point: str = ".") -> Column:
    plain = F.translate(c, drop + " \t\n\r" + NBSP, "")
    return F.when(c.rlike(pattern) & F.regexp_like(c, F.lit("[0-9]")), F.replace(plain, F.lit(point), F.lit(".")))


def _constant(value: str):
    return lambda c: F.when(c.isNotNull(), F.lit(value))


def _slash(c: Column, mark: str, day: int, month: int) -> Column:
    """Plain digits between marks, rearranged without a calendar check."""
    p = _whole(rf"(\d+){mark}(\d+){mark}(\d+)")
    return _fields(c, p, (day, month, 3), lambda d, m, y: F.concat_ws("-", year4(y), _two(m), _two(d)))


def _short(c: Column, day: int, month: int) -> Column:
    p = _whole(r"([0-9]{1,2})/([0-9]{1,2})")
    return _fields(c, p, (day, month), lambda d, m: F.concat(F.lit("--"), _two(m), F.lit("-"), _two(d)))


def _unit_number(c: Column, indian: bool = False) -> Column:
    """A major and a minor unit with words after them: 2 dollars 5 cents is 2.05."""
    c = F.translate(c, WIDE_DIGITS[0] + "，．", WIDE_DIGITS[1] + ",.")
    p = _whole(r"([0-9][0-9,. " + NBSP + r"]*)([^0-9]+)([0-9]{1,2})([^0-9]*)") if indian else r"^([0-9.,]+)([^0-9.,][^0-9]*)([0-9]{1,2})[^0-9]*$"
    return _fields(c, p, (1, 3), lambda major, minor: F.concat(F.translate(major, ",. " + NBSP, ""), F.lit("."), F.lpad(minor, 2, "0")))


def _canonical(c: Column) -> Column:
    whole = F.regexp_replace(F.split_part(c, F.lit("."), F.lit(1)), "^0+", "")
    part = F.when(c.contains("."), F.regexp_replace(F.split_part(c, F.lit("."), F.lit(2)), "0+$", "")).otherwise(F.lit(""))
    return F.when(c.isNotNull(), F.concat(F.when(whole == "", F.lit("0")).otherwise(whole), F.when(part == "", F.lit("")).otherwise(F.concat(F.lit("."), part))))


def _indian_number(c: Column) -> Column:
    p = rf"^((([0-9]{{1,2}}[, {NBSP}])?([0-9]{{2}}[, {NBSP}])*[0-9]{{3}})|([0-9]{{1,3}}))([.][0-9]+)?$|^([0-9]+)([.][0-9]+)?$"
    return F.when(c.rlike(p), F.translate(c, ", " + NBSP, ""))


def _era(c: Column, with_day: bool) -> Column:
    c = F.translate(c, *WIDE_DIGITS)
    space = r"[\s　]*"
    p = "^" + space + "(" + "|".join(sorted(ERAS, key=len, reverse=True)) + ")" + space + "([0-9]{1,2}|元)" + space + "年" + space + "([0-9]{1,2})" + space + "月" + space + ("([0-9]{1,2})" + space + "日" + space if with_day else "") + "$"
    first = F.create_map(*[F.lit(x) for kv in ERAS.items() for x in kv])

    def build(era: Column, n: Column, m: Column, d: Column | None = None) -> Column:
        y = (F.try_element_at(first, era) + F.when(n == "元", 1).otherwise(n.try_cast("int"))).cast("string")
        m = m.try_cast("int")
        return F.when(m.between(1, 12), F.concat_ws("-", y, _two(m))) if d is None else _valid_date(y, m, d.try_cast("int"))

    return _fields(c, p, (1, 2, 3, 4) if with_day else (1, 2, 3), build)


def _saka(c: Column) -> Column:
    """Indian national calendar: months start on fixed Gregorian days, a day earlier in leap years for the first."""
    c = F.translate(c, *DEVANAGARI)
    p = r"^\s*([0-9]{1,2})\s+(\S+(?:\s*\S+)??)\s+([0-9]{2}|[0-9]{4})\s*$"
    name, day, y = _group(c, p, 2), _group(c, p, 1).try_cast("int"), _group(c, p, 3)
    month = F.lit(None).cast("int")
    for n in range(12, 0, -1):
        month = F.when(name.rlike(f"^(?:{SAKA_MONTHS[n - 1]}|{SAKA_LATIN[n - 1]})$"), n).otherwise(month)
    century = F.when((y.cast("int") > 21) | ((y == "21") & (month >= 10) & (day >= 11)), "19").otherwise("20")
    g = (F.when(F.length(y) == 2, F.concat(century, y)).otherwise(y)).try_cast("int") + 78
    leap = (g % 4 == 0) & ((g % 100 != 0) | (g % 400 == 0))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), month)
    extra = (leap & (month == 1)).cast("int")
    start = F.make_date(g + pick([s[2] for s in SAKA_START]), pick([s[0] for s in SAKA_START]), pick([s[1] for s in SAKA_START]) - extra)
    fits = (day >= 1) & (day <= pick(SAKA_LENGTH) + extra)
    return F.when(c.rlike(p) & month.isNotNull() & fits, F.date_format(F.date_add(start, day - 1), "yyyy-MM-dd"))


def _roman(c: Column, kind: str) -> Column:
    names = [(r.lower(), i) for i, r in enumerate(ROMAN, 1)]
    m = "([XVIxvi]+)"
    if kind == "day":
        return _month_day(c, _whole(rf"{DAY}[^0-9]*[^XVIxvi]{m}"), 1, 2, names)
    if kind == "date":
        return _date(c, _whole(rf"{DAY}[^0-9]*[^XVIxvi0-9]{m}[^XVIxvi0-9][^0-9]*{YEAR}"), 1, 2, 3, names)
    return _year_month(c, _whole(rf"{m}[^XVIxvi0-9][^0-9]*{YEAR}"), 1, 2, names)


def _by_name(language: str, shape: str):
    """Formats with a month name: the shape names day, month and year in order."""
    pattern, names = _named(language, shape)
    tail = "" if language == "en" else "[^0-9]*?"
    if language == "cs":  # whole words: no letter may follow
        tail = r"\.?" if shape == "dm" else r"(?![0-9a-zA-Z])"
    flags = "(?iu)"
    gap = r"[^0-9]*[^0-9\p{L}]" if language in ("fi", "pl", "lt") else GAP
    end_day = "[^0-9]{0,2}" if language == "en" else "[^0-9]*"
    shapes = {
        "dm": (_month_day, rf"{DAY}{gap}{pattern}{tail}", (1, 2)),
        "dmy": (_date, rf"{DAY}{gap}{pattern}{tail}{GAP}{YEAR}", (1, 2, 3)),
        "my": (_year_month, rf"{pattern}{tail}{GAP}{YEAR}", (1, 2)),
        "md": (_month_day, rf"{pattern}{tail}{GAP}{DAY}{end_day}", (2, 1)),
        "mdy": (_date, rf"{pattern}{tail}{GAP}{DAY}{GAP}{YEAR}", (2, 1, 3)),
        "ym": (_year_month, rf"{YEAR}{gap}{pattern}[^0-9]*?", (2, 1)),
        "ymd": (_date, rf"{YEAR}{gap}{pattern}{tail}{GAP}{DAY}[^0-9]*", (3, 2, 1)),
        "ydm": (_date, rf"{YEAR}{GAP}{DAY}{gap}{pattern}[^0-9]*?", (2, 3, 1)),
    }
    build, body, places = shapes[shape]
    return lambda c: build(c, _whole(body, flags), *places, names=names)


def _english(names: list[str], shape: str):
    """First registry: names written exactly, single spaces."""
    table = [(n.lower(), i) for i, n in enumerate(names, 1)]
    m, y = "(" + "|".join(names) + ")", r"(\d{4}|\d{2})"
    d = r"(\d{1,2})"
    shapes = {
        "mdy": (_date, f"{m} {d}, {y}", (2, 1, 3)),
        "dmy": (_date, f"{d} {m} {y}", (1, 2, 3)),
        "dm": (_month_day, rf"{d}\s+{m}", (1, 2)),
        "md": (_month_day, rf"{m}\s+{d}[A-Za-z]{{0,2}}", (2, 1)),
        "ym": (_year_month, rf"{y}\s+{m}", (2, 1)),
        "my": (_year_month, rf"{m}\s+{y}", (1, 2)),
    }
    build, body, places = shapes[shape]
    return lambda c: build(c, _whole(body), *places, names=table)


def _digits(c: Column) -> Column:
    return F.translate(F.translate(c, *WIDE_DIGITS), *DEVANAGARI)


def _cjk(c: Column, with_day: bool) -> Column:
    s, n = r"[\s　]*", "([0-9]{1,2})"
    p = f"^{s}{YEAR}{s}年{s}{n}{s}月{s}" + (f"{n}{s}日{s}" if with_day else "") + "$"
    clean = lambda x: F.translate(x, *WIDE_DIGITS)
    return _date(c, p, 3, 2, 1, clean=clean) if with_day else _year_month(c, p, 2, 1, clean=clean)


THREES = "[0-9]{{1,3}}({sep}[0-9]{{3}})*"
TR1 = {
    "dateslashus": partial(_slash, mark="/", day=2, month=1),
    "dateslasheu": partial(_slash, mark="/", day=1, month=2),
    "datedotus": partial(_slash, mark=r"\.", day=2, month=1),
    "datedoteu": partial(_slash, mark=r"\.", day=1, month=2),
    "datelongus": _english(LONG_EN, "mdy"),
    "dateshortus": _english(SHORT_EN, "mdy"),
    "datelonguk": _english(LONG_EN, "dmy"),
    "dateshortuk": _english(SHORT_EN, "dmy"),
    "numcommadot": lambda c: _number(c, _whole(THREES.format(sep=",") + r"([.][0-9]+)?"), ","),
    "numdash": lambda c: F.when(c.rlike(_whole("-")), F.replace(c, F.lit("-"), F.lit("0"))),
    "numspacedot": lambda c: _number(c, _whole(THREES.format(sep=f"[ {NBSP}]") + r"([.][0-9]+)?"), " "),
    "numdotcomma": lambda c: _number(c, _whole(THREES.format(sep="[.]") + "(,[0-9]+)?"), ".", ","),
    "numcomma": lambda c: _number(c, _whole("[0-9]+(,[0-9]+)?"), "", ","),
    "numspacecomma": lambda c: _number(c, _whole(THREES.format(sep=f"[ {NBSP}]") + "(,[0-9]+)?"), " ", ","),
    "datelongdaymonthuk": _english(LONG_EN, "dm"),
    "dateshortdaymonthuk": _english(SHORT_EN, "dm"),
    "datelongmonthdayus": _english(LONG_EN, "md"),
    "dateshortmonthdayus": _english(SHORT_EN, "md"),
    "dateslashdaymontheu": partial(_short, day=1, month=2),
    "dateslashmonthdayus": partial(_short, day=2, month=1),
    "datelongyearmonth": _english(LONG_EN, "ym"),
    "dateshortyearmonth": _english(SHORT_EN, "ym"),
    "datelongmonthyear": _english(LONG_EN, "my"),
    "dateshortmonthyear": _english(SHORT_EN, "my"),
}
DAY_MONTH = _whole(f"{DAY}{GAP}{DAY}")
TR2 = {
    "booleanfalse": _constant("false"),
    "booleantrue": _constant("true"),
    "datedaymonth": lambda c: _month_day(c, DAY_MONTH, 1, 2),
    "datedaymonthen": _by_name("en", "dm"),
    "datedaymonthyear": lambda c: _date(c, _whole(f"{DAY}{GAP}{DAY}{GAP}{YEAR}"), 1, 2, 3),
    "datedaymonthyearen": _by_name("en", "dmy"),
    "dateerayearmonthdayjp": lambda c: _era(c, True),
    "dateerayearmonthjp": lambda c: _era(c, False),
    "datemonthday": lambda c: _month_day(c, _whole(f"{DAY}{GAP}{DAY}[A-Za-z]*"), 2, 1),
    "datemonthdayen": _by_name("en", "md"),
    "datemonthdayyear": lambda c: _date(c, _whole(f"{DAY}{GAP}{DAY}{GAP}{YEAR}"), 2, 1, 3),
    "datemonthdayyearen": _by_name("en", "mdy"),
    "datemonthyearen": _by_name("en", "my"),
    "dateyearmonthdaycjk": lambda c: _cjk(c, True),
    "dateyearmonthen": _by_name("en", "ym"),
    "dateyearmonthcjk": lambda c: _cjk(c, False),
    "nocontent": _constant(""),
    "numcommadecimal": lambda c: _number(c, _whole(rf"[0-9]{{1,3}}([. {NBSP}]?[0-9]{{3}})*(,[0-9]+)?"), ".", ","),
    "zerodash": lambda c: F.when(c.rlike(_whole("[-‐-―−]")), F.lit("0")),
    "numdotdecimal": lambda c: _number(c, _whole(rf"[0-9]{{1,3}}([, {NBSP}]?[0-9]{{3}})*([.][0-9]+)?"), ","),
    "numunitdecimal": _unit_number,
}
TR3 = TR2 | {
    "calindaymonthyear": _saka,
    "datedaymonthdk": _by_name("da", "dm"),
    "datedaymonthyeardk": _by_name("da", "dmy"),
    "datedaymonthyearin": lambda c: _by_name("hi", "dmy")(_digits(c)),
    "datemonthyear": lambda c: _year_month(c, _whole(f"{DAY}{GAP}{YEAR}"), 1, 2),
    "datemonthyeardk": _by_name("da", "my"),
    "datemonthyearin": lambda c: _by_name("hi", "my")(_digits(c)),
    "dateyearmonthday": lambda c: _date(c, f"^{EDGE}{YEAR}{GAP}{DAY}{GAP}{DAY}[^0-9]*$", 3, 2, 1, clean=_digits),
    "numdotdecimalin": _indian_number,
    "numunitdecimalin": partial(_unit_number, indian=True),
}
DAY_MONTHNAME = "bg cs da de el en es et fi fr hr it lv nl no pl pt ro se sk sl sv".split()
DAY_MONTHNAME_YEAR = "bg cs da de el en es et fi fr hi hr it nl no pl pt ro se sk sl dk".split()
MONTHNAME_YEAR = "bg cs da de el en es et fi fr hi hr it nl no pl pt ro se sk sl dk lv".split()


def _language(code: str) -> str:
    return {"sv": "da", "dk": "da"}.get(code, code)


def _clean_by_name(code: str, shape: str):
    build = _by_name(_language(code), shape)
    return (lambda c: build(_digits(c))) if code == "hi" else build


TR4 = (
    TR3
    | {f"date-day-monthname-{k}": _clean_by_name(k, "dm") for k in DAY_MONTHNAME}
    | {f"date-day-monthname-year-{k}": _clean_by_name(k, "dmy") for k in DAY_MONTHNAME_YEAR}
    | {f"date-monthname-year-{k}": _clean_by_name(k, "my") for k in MONTHNAME_YEAR}
    | {
        "date-day-month": TR2["datedaymonth"],
        "date-day-monthroman": lambda c: _roman(c, "day"),
        "date-day-month-year": lambda c: TR2["datedaymonthyear"](_digits(c)),
        "date-day-monthroman-year": lambda c: _roman(c, "date"),
        "date-ind-day-monthname-year-hi": _saka,
        "date-jpn-era-year-month-day": TR2["dateerayearmonthdayjp"],
        "date-jpn-era-year-month": TR2["dateerayearmonthjp"],
        "date-monthname-day-en": TR2["datemonthdayen"],
        "date-monthname-day-hu": _by_name("hu", "md"),
        "date-monthname-day-lt": _by_name("lt", "md"),
        "date-monthname-day-year-en": TR2["datemonthdayyearen"],
        "date-month-day": TR2["datemonthday"],
        "date-month-day-year": TR2["datemonthdayyear"],
        "date-month-year": lambda c: TR3["datemonthyear"](_digits(c)),
        "date-monthroman-year": lambda c: _roman(c, "month"),
        "date-year-day-monthname-lv": _by_name("lv", "ydm"),
        "date-year-month": lambda c: _year_month(c, f"^{EDGE}{YEAR}{GAP}{DAY}[^0-9]*$", 2, 1, clean=_digits),
        "date-year-month-day": TR3["dateyearmonthday"],
        "date-year-monthname-en": TR2["dateyearmonthen"],
        "date-year-monthname-hu": _by_name("hu", "ym"),
        "date-year-monthname-day-hu": _by_name("hu", "ymd"),
        "date-year-monthname-day-lt": _by_name("lt", "ymd"),
        "date-year-monthname-lt": _by_name("lt", "ym"),
        "date-year-monthname-lv": _by_name("lv", "ym"),
        "fixed-empty": _constant(""),
        "fixed-false": _constant("false"),
        "fixed-true": _constant("true"),
        "fixed-zero": _constant("0"),
        "num-comma-decimal": lambda c: _number(c, _whole(rf"[. {NBSP}0-9]*(,[ {NBSP}0-9]+)?"), ".", ","),
        "num-dot-decimal": lambda c: _number(c, _whole(rf"[, {NBSP}0-9]*([.][ {NBSP}0-9]+)?"), ","),
        "numdotdecimalin": lambda c: _canonical(_indian_number(c)),
        "num-unit-decimal": _unit_number,
    }
)
#: The registries' namespaces.
REGISTRIES = {
    "http://www.xbrl.org/2008/inlineXBRL/transformation": TR1,
    "http://www.xbrl.org/inlineXBRL/transformation/2010-04-20": TR1,
    "http://www.xbrl.org/inlineXBRL/transformation/2011-07-31": TR2,
    "http://www.xbrl.org/inlineXBRL/transformation/2015-02-26": TR3,
    "http://www.xbrl.org/inlineXBRL/transformation/2020-02-12": TR4,
}


def transform(col: Column, name: str, registry: dict | str = TR4) -> Column:
    """The normal form of a text by a format's name; NULL where it doesn't fit."""
    table = REGISTRIES[registry] if isinstance(registry, str) else registry
    if name not in table:
        raise KeyError(f"the registry has no format {name}")
    return table[name](col)


def transform_by_column(col: Column, name: Column, registry: dict | str = TR4, names: list[str] | None = None) -> Column:
    """The format is named in each row; ``names`` limits the formats that are looked for."""
    table = REGISTRIES[registry] if isinstance(registry, str) else registry
    out = F.lit(None).cast("string")
    for n in names or table:
        out = F.when(name == n, table[n](col)).otherwise(out)
    return out


def once_each(rows: DataFrame, key: str, made: dict[str, Column]) -> DataFrame:
    """``rows`` with columns made of one key column, which are worked out once for each of its values, null included."""
    each = rows.select(key).distinct().select(F.col(key).alias("_key"), *[c.alias(n) for n, c in made.items()])
    return rows.join(each, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def errors(col: Column, name: str, registry: dict | str = TR4) -> Column:
    return col.isNotNull() & transform(col, name, registry).isNull()


def scaled(number: Column, scale: Column, sign: Column) -> Column:
    """Formatted content times ten to the scale, negated by a sign."""
    n = number.try_cast("decimal(38,12)").cast("double") * F.pow(F.lit(10.0), F.coalesce(scale.cast("double"), F.lit(0.0)))
    return F.when(sign == "-", -n).otherwise(n)
