"""Personal data in texts, in DataFrame functions only.

Regular expressions propose spans, checksum validators (Luhn for cards, mod 97 for account numbers) and digit counts confirm them,
and words near a span raise its score. Each pattern runs once over a text: it marks its matches, the marked text is split, and a
fold over the parts keeps track of the position in code points and collects the confirmed spans.

Patterns are written so that they take time in proportion to the text: runs are possessive and start only where a run starts,
which finds the same leftmost matches. None of them recurses, so that no text is too long.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fresh

MARK, NOT_MARK = "\x01", "\x02"
SPAN = "array<struct<start:bigint,rank:int,stop:bigint,kind:string,score:double>>"
#: Characters on either side of a match in which context words count.
NEAR = 40
#: Of the kinds that the method adds, spans from this score on are reported.
LEAST = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    base: bool
    score: float
    context: str
    needs: str


_LOCAL = r"[A-Za-z0-9._%+-]"
#: In the order that breaks ties of equal starts.
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, 0.9, "mail|contact|write|schreib|correo", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, 0.6, "ip|address|adresse|server|host|login", "[0-9]"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", True, 0.7, "card|visa|credit|karte|carte|tarjeta|payment", "[0-9]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True, 0.6, "phone|tel|call|mobile|fax|anruf", r"\+[0-9]"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", False, 0.9, "iban|bank|konto|compte|cuenta|account", "[A-Z]{2}[0-9]{2}"),
    Kind("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[A-Za-z0-9+/_-]{40,88}={0,2})(?![A-Za-z0-9+/_=-])", False, 0.4, "token|secret|password|passwd|api.?key|credential|bearer", "[A-Za-z0-9+/_-]{32}"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", False, 0.4, "ssn|social|security", "[0-9]-[0-9]{2}-[0-9]"),
)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the weighted digit sum of a string of digits is a multiple of ten."""
    back = F.reverse(digits)
    doubled = F.translate(back, "0123456789", "0246813579")
    digit = lambda i: F.substring(F.when(i % 2 == 1, back).otherwise(doubled), i, 1).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + digit(i)) % 10 == 0


def mod_97(account: Column) -> Column:
    """True if an account number, its first four characters moved behind the others and letters read as 10 to 35, is 1 modulo 97."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(total: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, 1))
        return F.when(code < 58, total * 10 + code - 48).otherwise(total * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    """What a match of this kind has to fulfil."""
    if kind == "ip":
        part = r"(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        size = F.length(_digits(match))
        return F.when((size >= 12) & (size <= 19), luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        size = F.length(_digits(match))
        return (size >= 9) & (size <= 15)
    if kind == "iban":
        size = F.length(F.replace(match, F.lit(" "), F.lit("")))
        return F.when((size >= 15) & (size <= 34), mod_97(match)).otherwise(F.lit(False))
    return F.lit(True)


def kind_parts(text: Column, kind: Kind) -> Column:
    """What lies between the matches of a kind, and the matches, in turn; null where a text lacks what every match needs."""
    marked = F.regexp_replace(F.translate(text, MARK, NOT_MARK), kind.pattern, f"{MARK}$0{MARK}")
    return F.when(text.rlike(kind.needs), F.split(marked, MARK, -1))


def kind_spans(parts: Column, kind: Kind) -> Column:
    """The confirmed spans among such parts, in order."""
    rank = KINDS.index(kind)
    empty = F.array().cast(SPAN)

    def step(so_far: Column, i: Column) -> Column:
        between, match = F.get(so_far["parts"], i - 1), F.get(so_far["parts"], i)
        start = so_far["at"] + F.length(between)
        stop = start + F.length(match)
        around = F.lower(F.concat_ws(" ", F.right(between, F.lit(NEAR)), F.left(F.get(so_far["parts"], i + 1), F.lit(NEAR))))
        score = F.lit(kind.score) + F.when(around.rlike(rf"\b(?:{kind.context})"), F.lit((1 - kind.score) / 2)).otherwise(F.lit(0.0))
        found = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.lit(kind.name).alias("kind"), score.alias("score")))
        passes = confirmed(kind.name, match) if kind.base else confirmed(kind.name, match) & (score >= LEAST)
        return F.struct(stop.alias("at"), F.when(passes, F.concat(so_far["found"], found.cast(SPAN))).otherwise(so_far["found"]).alias("found"), so_far["parts"].alias("parts"))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("found"), parts.alias("parts"))
    folded = F.aggregate(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), begin, step, lambda end: end["found"])
    return F.when(F.size(parts) > 2, folded).otherwise(empty)


def with_spans(docs: DataFrame, text: str = "text", into: str = "_spans") -> DataFrame:
    """docs and a column `into`: all spans, by start and then kind."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    names = [fresh(f"_{into}_{k.name}", docs.columns) for k in KINDS]
    own = [F.col(f"`{c}`") for c in docs.columns]
    # Each step names what the next one uses several times, so that it is worked out once.
    parts = docs.select("*", *[kind_parts(whole, k).alias(n) for k, n in zip(KINDS, names)])
    each = parts.select(*own, *[kind_spans(F.col(n), k).alias(n) for k, n in zip(KINDS, names)])
    return each.select(*own, F.array_sort(F.concat(*names)).alias(into))


def _shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (one for each span, joined likewise), n_spans.

    A null text is an empty one: no spans, and the digest of the empty string. Repeated rows stay repeated; spans of different
    kinds may overlap and are all reported, those of one kind never do. An empty table gives no row. Only doc_id and text are
    read. Texts are searched whole.
    """
    found = with_spans(docs.select("doc_id", "text"))
    base = [k.name for k in KINDS if k.base]
    count = lambda name: F.size(F.filter("_spans", lambda s: s["kind"] == name)).cast("bigint")
    return found.select(
        "doc_id", *[count(name).alias(f"n_{name}") for name in base],
        F.sha2(_shown(F.filter("_spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        _shown(F.col("_spans")).alias("spans"),
        F.array_join(F.transform("_spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
        F.size("_spans").cast("bigint").alias("n_spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; overlapping spans are replaced as one by the first's kind.

    Null texts stay null. A column n_chars, if there is one, is brought up to date. All other columns are kept as they are.
    """
    name = fresh("_spans", docs.columns)
    found = with_spans(docs, into=name)
    spans, text = F.col(name), F.col("text")

    def step(so_far: Column, span: Column) -> Column:
        new = span["start"] >= so_far["at"]
        kept = F.substring(text, (so_far["at"] + 1).cast("int"), (span["start"] - so_far["at"]).cast("int"))
        out = F.when(new, F.concat(so_far["out"], kept, F.lit("["), F.upper(span["kind"]), F.lit("]"))).otherwise(so_far["out"])
        return F.struct(F.greatest(so_far["at"], span["stop"]).alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    rest = lambda end: F.concat(end["out"], F.substring(text, (end["at"] + 1).cast("int"), F.length(text)))
    clean = F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, rest)).otherwise(text)
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(text.isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
