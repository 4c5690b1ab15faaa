"""Personal data and secrets: patterns propose spans, checks confirm them, words nearby move their score.

Expressions are native throughout. Places are code points, ends exclusive. Matches are
leftmost and do not overlap within a kind; those that a validator refuses are dropped
without another try. Account numbers (IBAN) are tried from every start: of the texts there that end
before a space or at the last letter or digit, the longest that mod-97 confirms. Secrets are long runs of letters and digits, both of
them and of enough different ones.

A kind has a score of its own; one of its words, as a whole word within REACH characters before or after the span, raises it. Base kinds keep every
confirmed span, whatever its score; the others keep those that score ACCEPT, which social security numbers and secrets reach by such words alone.

Patterns use possessive repeats and look-behinds so that each is linear in the text; they
match exactly what the plain patterns beside them match.

Defined cases: a null text is empty and has no spans; long texts are read whole; repeated
rows are judged each; spans of different kinds may overlap, and are listed by kind, then by start; an empty table gives no rows; other columns of docs,
whatever their names, are kept in row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: True for a text that may hold a match; cheap.
    hint: str
    score: float
    #: Lower-case words that raise the score if they stand within REACH of the span.
    near: str
    base: bool


#: An account number and what of the words after it looks like more of it; LONGEST has room for 34 characters, spaces between them and one more.
ACCOUNT, LONGEST = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+", 68
#: Characters of the longest secret.
SECRET = 512
REACH = 48
CONTEXT = 0.35
ACCEPT = 0.5

KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write", True),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", ".", 0.6, "ip|host|server|address", True),
    # [0-9]([\x20-]?[0-9])+ of 13 digits or more
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", "", 0.7, "card|visa|credit|pay|carte|tarjeta|karte", True),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "phone|tel|call|mobile|fax", True),
    # the start alone, as what follows may be eaten too; _accounts() finds the end
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})", "", 0.8, "iban|account|bank|konto|compte|cuenta", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social|security|tax", False),
    Kind("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+", "", 0.3, "token|secret|password|passwd|pwd|key|apikey|api_key|access_key|bearer|credential|credentials", False),
)


def luhn(digits: Column) -> Column:
    """True if the sum of the digits, each second one from the right doubled, ends in 0."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def mod97(account: Column) -> Column:
    """True if the account number, its first four characters last and letters as 10 to 35, leaves 1 when divided by 97."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def step(a: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c < 58, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(part(p)) <= 3, part(p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        packed = F.translate(m, " ", "")
        return F.when(F.length(packed).between(15, 34), mod97(packed)).otherwise(False)
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)") & ~m.rlike("-00-|-0000$")
    if kind == "secret":
        characters = F.size(F.array_distinct(F.split(m, "")))
        return F.when(F.length(m) > SECRET, False).otherwise(m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (characters >= 8))
    return F.lit(True)


def _proposed(t: Column, kind: Kind) -> Column:
    """(value, start) of every match. The text between matches has the lengths that give the places.

    Starts run on from match to match; the running sum is kept in blocks so that a text with very many
    matches costs no square of their number."""
    return F.struct(F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0)).alias("m"), F.split(t, kind.pattern, -1).alias("g"))


BLOCK = 64


def _running(lengths: Column) -> Column:
    """Running sums of an array of ints, in blocks of BLOCK and of blocks."""
    zero = F.array().cast("array<int>")
    add = lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["l"], F.array(a["s"] + x)).alias("l"))
    sums = lambda xs: F.aggregate(xs, F.struct(F.lit(0).alias("s"), zero.alias("l")), add, lambda a: a["l"])
    starts = F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(BLOCK))
    blocks = F.transform(starts, lambda i: F.slice(lengths, i, F.lit(BLOCK)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    before = F.concat(F.array(F.lit(0)), sums(totals))
    return F.flatten(F.transform(blocks, lambda b, k: F.transform(sums(b), lambda x: x + F.get(before, k))))


def find(docs: DataFrame, text: str = "text", keep: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """row (struct of docs' columns, or of those keep gives), and for each kind an array of
    (kind, start, end, value, score); base kinds keep every valid match, the others those that score ACCEPT."""
    row = keep(docs) if keep else F.struct(*docs.columns)
    df = docs.select(row.alias("row"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    t = F.col("_t")
    df = df.select("row", "_t", t.rlike("[0-9]").alias("_digit"))
    maybe = lambda k: (F.lit(True) if k.name == "email" else F.col("_digit")) & (F.contains(t, F.lit(k.hint)) if k.hint else F.lit(True))
    df = df.select("row", "_t", *(F.when(maybe(k), _proposed(t, k)).alias(f"_p_{k.name}") for k in KINDS))
    df = df.select("row", "_t", *(F.when(F.size(F.col(f"_p_{k.name}")["m"]) > 0, F.col(f"_p_{k.name}")).alias(f"_p_{k.name}") for k in KINDS))
    found = lambda k: F.col(f"_p_{k.name}")
    lengths = lambda k: F.zip_with(found(k)["m"], F.slice(found(k)["g"], F.lit(1), F.size(found(k)["m"])), lambda m, g: F.length(m) + F.length(g))
    df = df.select("*", *(F.when(found(k).isNotNull(), lengths(k)).alias(f"_l_{k.name}") for k in KINDS))
    df = df.select("*", *(F.when(found(k).isNotNull(), _running(F.col(f"_l_{k.name}"))).alias(f"_e_{k.name}") for k in KINDS))
    df = df.select("*", *(_spans(t, k).alias(f"_s_{k.name}") for k in KINDS))
    return df.select("row", *(_kept(k).alias(k.name) for k in KINDS))


SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def _spans(t: Column, kind: Kind) -> Column:
    """The spans that the validator of the kind confirms; null where none are proposed."""
    ends = F.col(f"_e_{kind.name}")

    word = rf"(?<![\p{{L}}\p{{N}}])(?:{kind.near})(?![\p{{L}}\p{{N}}])"

    def span(m: Column, start: Column) -> Column:
        end = start + F.length(m)
        left = F.greatest(start - REACH, F.lit(0))
        # a word that the reach cuts is none
        before = F.when(left > 0, F.regexp_replace(F.substr(t, left + 1, start - left), r"^[\p{L}\p{N}]+", "")).otherwise(F.substr(t, left + 1, start - left))
        more = F.substr(t, end + 1, F.lit(REACH))
        after = F.when(F.length(more) == REACH, F.regexp_replace(more, r"[\p{L}\p{N}]+$", "")).otherwise(more)
        near = F.lower(before).rlike(word) | F.lower(after).rlike(word)
        score = F.lit(kind.score) + F.when(near, F.lit(CONTEXT)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), m.alias("value"), F.least(score, F.lit(1.0)).alias("score"))

    start = lambda m, i: F.get(ends, i) - F.length(m)
    found = F.col(f"_p_{kind.name}")["m"]
    if kind.name == "iban":
        return F.transform(_accounts(t, F.transform(found, start)), lambda x: span(x["m"], x["start"])).cast(SPAN)
    return F.filter(F.transform(found, lambda m, i: span(m, start(m, i))), lambda s: _valid(kind.name, s["value"])).cast(SPAN)


def _kept(kind: Kind) -> Column:
    spans = F.col(f"_s_{kind.name}")
    good = spans if kind.base else F.filter(_apart(spans) if kind.name == "iban" else spans, lambda s: s["score"] >= ACCEPT)
    return F.coalesce(good, F.array().cast(SPAN))


def _accounts(t: Column, starts: Column) -> Column:
    """(start, m): the longest valid account number at each start that has one, with no letter or digit after it."""
    near = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substr(t, s + 1, F.lit(LONGEST)).alias("t")))
    most = F.transform(near, lambda x: F.struct(x["start"].alias("start"), x["t"].alias("t"), F.regexp_extract(x["t"], ACCOUNT, 0).alias("m")))
    torn = lambda x: F.substr(x["t"], F.length(x["m"]) + 1, F.lit(1)).rlike("[A-Za-z0-9]").cast("int")
    words = F.transform(most, lambda x: F.struct(x["start"].alias("start"), F.split(x["m"], " ").alias("w"), torn(x).alias("torn")))
    prefixes = lambda x: F.transform(F.slice(x["w"], F.lit(1), F.size(x["w"]) - x["torn"]), lambda _, i: F.array_join(F.slice(x["w"], F.lit(1), i + 1), " "))
    valid = F.transform(words, lambda x: F.struct(x["start"].alias("start"), F.filter(prefixes(x), lambda m: _valid("iban", m)).alias("m")))
    return F.transform(F.filter(valid, lambda x: F.size(x["m"]) > 0), lambda x: F.struct(x["start"].alias("start"), F.element_at(x["m"], -1).alias("m")))


def _apart(spans: Column) -> Column:
    """Spans in order of start without those that begin inside one kept before."""
    meets = lambda s, i: (i > 0) & (F.get(spans, i - 1)["end"] > s["start"])
    inside = lambda a, s: F.coalesce(F.get(a, F.size(a) - 1)["end"] > s["start"], F.lit(False))
    fold = F.aggregate(spans, F.array().cast(SPAN), lambda a, s: F.when(inside(a, s), a).otherwise(F.concat(a, F.array(s))))
    return F.when(F.exists(F.transform(spans, meets), lambda x: x), fold).otherwise(spans)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
