"""Texts of reports and cards, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TRAITS

#: Words that name a trait or its level, and so may not stand on a card.
LABELS = (*TRAITS, r"agreeab\w*", r"conscientious\w*", r"neurotic\w*", r"extr[ao]ver\w*", r"introver\w*", r"open-minded\w*", "high", "low", "nars")
_BLANK = r"[\s\x1c-\x1f]"
_BREAK = r"[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def label_word(text: Column | str) -> Column:
    """The first label in a text, as it stands there; empty without one."""
    return F.regexp_extract(_c(text), rf"(?iuU)\b({'|'.join(LABELS)})\b", 1)


def sentence_problem(text: Column | str) -> Column:
    """Why a text can't be a sentence of a card: empty (or null), blanks around it or more than
    one line, or a label in it; null if it can."""
    text = _c(text)
    label = label_word(text)
    return (
        F.when(text.isNull() | (text == ""), "empty")
        .when(text.rlike(rf"(?U)\A{_BLANK}|{_BLANK}\z|{_BREAK}"), "not_one_line")
        .when(label != "", F.concat(F.lit("label:"), F.lower(label)))
    )


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _ten_thousandths(x: Column) -> Column:
    """The whole number next to x * 10,000, as a double, judged by the exact binary value; ties
    go to the even one. For x from 0 to 2^39.

    The product rounds; what it leaves out is exact (x in two halves of at most 26 bits each),
    so a comparison with one half needs no more digits."""

    def judged(v: Column) -> Column:
        product, floor, left_out = v["product"], v["floor"], v["left_out"]
        part, odd = product - floor, F.pmod(floor, F.lit(2.0)) == 1.0
        up = (part > 0.5) | ((part == 0.5) & ((left_out > 0) | ((left_out == 0) & odd))) | ((part == 0) & (left_out == 0.5) & odd)
        down = (part == 0) & (left_out == -0.5) & odd
        return floor + F.when(up, 1.0).when(down, -1.0).otherwise(0.0)

    high = x * 134217729.0 - (x * 134217729.0 - x)
    product = x * 10000.0
    left_out = (high * 10000.0 - product) + (x - high) * 10000.0
    return _let(F.struct(product.alias("product"), F.floor(product).cast("double").alias("floor"), left_out.alias("left_out")), judged)


def _whole_digits(x: Column, n: int) -> Column:
    """The n leading digits of a double that is a whole number below 2^63, rounded by its exact
    value, as d.ddde+m; null for other ones."""

    def cut(v: Column) -> Column:
        size = F.length(v.cast("string"))
        step = F.pow(F.lit(10.0), size - n).cast("bigint")

        def joined(q: Column) -> Column:
            more = F.length(q) - n  # one more digit where all of them were nines
            return F.concat(F.substring(q, 1, 1), F.lit("."), F.substring(q, 2, n - 1), F.lit("e+"), (size - 1 + more).cast("string"))

        return F.when(size > n, _let(F.floor((v.cast("decimal(20,0)") + F.floor(step / 2)) / step).cast("string"), joined))

    return F.when((x >= 1e15) & (x < 9.2e18), _let(x.cast("bigint"), cut))


def _shortest(x: Column) -> Column:
    """The fewest digits that stand for the double x, as d.ddde±n. From 2^63 on, where several
    texts of 16 digits stand for it, any of them."""
    tries = [F.coalesce(_whole_digits(x, n + 1), F.format_string(f"%.{n}e", x)) for n in (14, 15)]
    return F.coalesce(*[_let(t, lambda t: F.when(t.try_cast("double") == x, t)) for t in tries], F.format_string("%.16e", x))


def _plain(text: Column) -> Column:
    """Decimals without the noughts at their end, but one."""
    return F.regexp_replace(text, r"(\.[0-9]+?)0+$", "$1")


def _large(x: Column) -> Column:
    """The text of a double from 1e11 on."""

    def written(text: Column) -> Column:
        exponent = F.regexp_extract(text, r"e([+-][0-9]+)$", 1).try_cast("int")
        mantissa = F.regexp_replace(F.regexp_extract(text, r"^([0-9.]+)", 1), r"\.?0+$", "")
        return F.when(exponent < 16, _plain(text.try_cast("decimal(38,6)").cast("string"))).otherwise(F.concat(mantissa, F.lit("e+"), exponent.cast("string")))

    return _let(_shortest(x), written)


def four_decimals(x: Column | str) -> Column:
    """A double rounded to four decimals by its exact binary value, half to even, and written
    with the fewest digits that stand for the result: 2.00005 gives 2.0 and -0.00001 gives
    -0.0. From 1e16 on an exponent is written (1e+20). Empty for null."""

    def written(x: Column) -> Column:
        sign = F.when((x < 0) | x.cast("string").startswith("-"), "-").otherwise("")
        ten = F.lit(10000).cast("decimal(20,0)")
        small = _plain((_ten_thousandths(F.abs(x)).cast("decimal(20,0)") / ten).cast("decimal(20,4)").cast("string"))
        # from 1e11 on four decimals may not be kept apart; from 2^39 on rounding changes nothing
        large = _let(F.when(F.abs(x) < float(1 << 39), _ten_thousandths(F.abs(x)) / 10000.0).otherwise(F.abs(x)), _large)
        return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf"))).when(F.abs(x) < 1e11, F.concat(sign, small)).otherwise(F.concat(sign, large))

    return F.coalesce(_let(_c(x).cast("double"), written), F.lit(""))


def _utc(at: Column) -> Column:
    """To the second, by arithmetic on the instant, so that no session's zone comes in. Spark puts
    a plus before years of more than four digits, which goes."""
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_seconds(at).cast("decimal(18,6)"))
    text = (F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + since).cast("string")
    return F.ltrim(F.replace(text, F.lit(" "), F.lit("T")), F.lit("+"))


def utc_seconds(at: Column | str) -> Column:
    """A time as UTC text to the second, whatever the session's zone; null stays null."""
    return F.concat(_utc(_c(at)), F.lit("Z"))


def utc_millis(at: Column | str) -> Column:
    """The same to the millisecond."""
    at = _c(at)
    return F.concat(_utc(at), F.lit("."), F.lpad(F.pmod(F.unix_millis(at), F.lit(1000)).cast("string"), 3, "0"), F.lit("Z"))
