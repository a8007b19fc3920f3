"""Text forms of numbers, times and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widths of the sexagesimal forms: how many of hundredths of a second are half of the last digit shown (fixed values).
HALF = {9: 0.5, 8: 5.0, 6: 50.0, 5: 300.0, 3: 3000.0}


def parse_sexagesimal(text: Column) -> Column:
    """The value of [+-]D:MM[:SS[.ss]] or [+-]D:MM.m found anywhere in a text; null otherwise."""
    pattern = r"([+-]?)(\d+):(\d+)(?:(?::(\d+)(?:\.(\d{1,2}))?)|(?:\.(\d)))?"
    part = lambda k: F.regexp_extract(text, pattern, k)
    number = lambda k: F.when(part(k) == "", 0.0).otherwise(F.try_to_number(part(k), F.lit("999999999")).cast("double"))
    hundredths = number(5) / F.when(F.length(part(5)) == 2, 100.0).otherwise(10.0)
    value = number(2) + (number(3) + number(6) / 10) / 60 + (number(4) + hundredths) / 3600
    # a full form anywhere in the text goes before a shorter one, as do more digits; one pattern finds the longest at the first place
    return F.when(part(2) != "", F.when(part(1) == "-", -value).otherwise(value))


def format_sexagesimal(value: Column, form: int, zero: bool = False, plus: bool = False, units: tuple[str, str, str] = (":", ":", "")) -> Column:
    """Form 9: D:MM:SS.ss, 8: one digit of seconds less, 6: D:MM:SS, 5: D:MM.m, 3: D:MM; rounded half up."""
    a = F.abs(value)
    whole = F.floor(a)
    # binary noise of the fraction must not move a digit, hence the rounding before the cut
    hundredths = F.floor(F.round((a - whole) * 360000 + HALF[form], 6)).cast("long")
    over = hundredths >= 360000
    whole = F.when(over, whole + 1).otherwise(whole).cast("int")
    s = F.when(over, hundredths - 360000).otherwise(hundredths)
    minutes = F.floor(s / 6000).cast("int")
    seconds = F.pmod(s, F.lit(6000)).cast("int")
    sign = F.when(value < 0, "-").otherwise("+" if plus else "")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    head = F.concat(sign, F.when(F.length(whole.cast("string")) < 2, two(whole)).otherwise(whole.cast("string")) if zero else whole.cast("string"), F.lit(units[0]), two(minutes))
    full = F.concat(head, F.lit(units[1]), two(F.floor(seconds / 100).cast("int")))
    tail = F.pmod(seconds, F.lit(100))
    if form == 3:
        return head
    if form == 5:
        return F.concat(head, F.lit("."), F.floor(seconds / 600).cast("string"))
    if form == 6:
        return F.concat(full, F.lit(units[2]))
    if form == 8:
        return F.concat(full, F.lit("."), F.floor(tail / 10).cast("string"), F.lit(units[2]))
    return F.concat(full, F.lit("."), two(tail), F.lit(units[2]))


def name_tokens(name: Column) -> Column:
    """Runs of digits (without leading zeros) and of other characters of a name in lower case; blanks and dashes part them."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|[^\d\s-]+)"), 1)
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.regexp_replace(p, r"^0+(?=\d)", "")).otherwise(p))


def exposure_text(seconds: Column) -> Column:
    """Exposure for a file name: seconds, or milli- or microseconds for short ones (the factors are fixed values)."""
    whole = lambda c: F.bround(c).cast("long").cast("string")
    return (
        F.when(seconds >= 1, F.concat(whole(seconds), F.lit("s")))
        .when(seconds >= 0.001, F.concat(whole(seconds * 1000.8), F.lit("ms")))
        .otherwise(F.concat(whole(seconds * 1000000.8), F.lit("us")))
    )


def temperature_text(degrees: Column) -> Column:
    """Whole degrees with a sign, ties to even; what lies below zero keeps its minus even where it is rounded to zero."""
    n = F.abs(F.bround(degrees).cast("int")).cast("string")
    return F.concat(F.when(degrees < 0, "-").otherwise("+"), n, F.lit("C"))


def flags_text(flags: Column, letters: str = "DBPFS") -> Column:
    """The letters of the bits that are set, without anything between them."""
    return F.concat(*[F.when(flags.bitwiseAND(1 << k) != 0, c).otherwise("") for k, c in enumerate(letters)])


def duration_text(seconds: Column, short: bool = False) -> Column:
    """Hours with minutes, or minutes, or seconds, each cut to whole ones: "1 h. 5 min.", "7 min.", "45 sec."; short: "1h5m", "7m", "45s"."""
    s = F.greatest(seconds, F.lit(0)).cast("long")
    minutes = F.floor(s / 60)
    number = lambda c: c.cast("long").cast("string")
    h, m, unit = ("h", "m", "s") if short else (" h. ", " min.", " sec.")
    hours = F.floor(minutes / 60)
    return (
        F.when(hours != 0, F.concat(number(hours), F.lit(h), number(minutes % 60), F.lit(m)))
        .when(minutes != 0, F.concat(number(minutes), F.lit(m)))
        .otherwise(F.concat(number(s), F.lit(unit)))
    )


def master_name(kind: Column, exposure: Column, gain: Column, offset: Column, width: Column, height: Column, binning: Column, temp: Column, date: Column) -> Column:
    """The file name of a master frame: kind is "light", "flat", "dark" or "bias"; a bias has no exposure, only a flat a date. A null temperature is left out."""
    head = F.when(kind == "bias", kind).otherwise(F.concat_ws("_", kind, exposure_text(exposure)))
    day = F.when(kind == "flat", F.date_format(date, "yyyy-MM-dd"))
    return F.concat(F.concat_ws("_", head, *_frame_part(gain, offset, width, height, binning, temp), day), F.lit(".fit"))


def raw_folder(kind: Column, exposure: Column, gain: Column, offset: Column, width: Column, height: Column, binning: Column, temp: Column, date: Column) -> Column:
    """The folder in which raw frames are kept; two underscores stand between its date and its exposure."""
    return F.concat_ws("_", kind, F.date_format(date, "yyyy-MM-dd"), F.lit(""), exposure_text(exposure), *_frame_part(gain, offset, width, height, binning, temp))


def defect_name(width: Column, height: Column, binning: Column) -> Column:
    """The file name of a list of defective pixels."""
    return F.concat(F.concat_ws("_", F.lit("defect_pixels"), _size(width, height), _binning(binning)), F.lit(".txt"))


def _size(width: Column, height: Column) -> Column:
    return F.concat(width.cast("string"), F.lit("x"), height.cast("string"))


def _binning(n: Column) -> Column:
    return F.when(n != 1, F.concat(F.lit("bin"), n.cast("string"), F.lit("x"), n.cast("string")))


def _frame_part(gain: Column, offset: Column, width: Column, height: Column, binning: Column, temp: Column) -> list[Column]:
    return [F.concat(F.lit("g"), gain.cast("string")), F.concat(F.lit("offs"), offset.cast("string")), _size(width, height), _binning(binning), F.when(temp.isNotNull(), temperature_text(temp))]


def number_text(value: Column, form: Column) -> Column:
    """A number in a form given as text: %w.pf (padded on the left to w), %...g (shortest), %w.pm (sexagesimal, p names the form); else 7 digits."""
    parts = lambda k, kind: F.regexp_extract(form, rf"%(\d*)\.(\d*){kind}", k)
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    digits = lambda p: F.regexp_replace(F.format_number(value, p), ",", "")

    def fixed(width: Column, places: Column) -> Column:
        out = F.when(places == 0, digits(0))
        for k in range(1, 16):
            out = out.when(places == k, digits(k))
        text = out.otherwise(digits(16))
        return F.when(F.length(text) < width, F.lpad(text, F.greatest(width, F.lit(1)), F.lit(" "))).otherwise(text)

    float_form, sexa_form = "[Ff]", "[Mm]"
    is_float, is_sexa = form.rlike(r"%\d*\.\d*[Ff]"), form.rlike(r"%\d*\.\d*[Mm]")
    shortest = lambda v: F.regexp_replace(F.regexp_replace(v.cast("decimal(38,17)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    frac, zero = number(parts(2, sexa_form)), parts(1, sexa_form).startswith("0")
    sexa = shortest(F.abs(value))
    for k in (3, 5, 6, 8, 9):
        shown = F.when(zero, format_sexagesimal(value, k, zero=True)).otherwise(format_sexagesimal(value, k))
        sexa = F.when(frac == k, shown).otherwise(sexa)
    return (
        F.when(is_float, fixed(number(parts(1, float_form)), number(parts(2, float_form))))
        .when(form.rlike("%.*[Gg]"), shortest(value))
        .when(is_sexa, sexa)
        .otherwise(digits(7))
    )
