"""Personal data by patterns, checksums and context, with built-in column functions only.

Patterns propose spans, leftmost and without overlap for each kind; validators (Luhn, mod 97, ranges, digit counts)
confirm them, and words near a span add to its score. The base kinds (email, ip, card, phone) are reported whenever
they are valid; the further kinds, secrets such as keys and passwords among them, where their score reaches ``least``
and no base span overlaps.

Positions come from splitting a text at the same pattern: a match starts after the gaps and matches before it. They
count code points, ends are exclusive. Texts are read whole, once; nothing is shuffled.

Defined results: null and empty texts have no spans; repeated rows each get their own row; an empty table gives no
rows; other columns are ignored by ``find`` and kept by ``with_spans``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm._common import bound

BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: texts of which a match has one; texts without any are not searched
    needs: tuple[str, ...]
    base: bool
    #: score of a valid match, and of context words before or after it
    score: float
    context: str = ""


# Lengths of IBANs by country, those of ISO 13616's registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "BI FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Each country's IBAN has its own length, so that a word in capitals behind it is none of it.
IBAN = "(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"


#: The card pattern takes whole runs of digits of the right length only, which drops the other runs unseen. Email and
#: ip patterns start where a run of their characters starts (or the last match ended), as other starts in it fail
#: alike, and never give characters back: long runs take time in proportion, and no stack.
KINDS = (
    Kind("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",), True, 0.9, r"mail|contact|write to|reach"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", (".",), True, 0.7, r"\bip\b|host|server|address"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])", (), True, 0.8, r"card|visa|master|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", ("+",), True, 0.7, r"tel|phone|call|fax|mobil"),
    Kind("iban", IBAN, (), False, 0.8, r"iban|account|bank|konto|compte|cuenta"),
    Kind("short_card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}(?![ -]?[0-9])", (), False, 0.4, r"card|amex|american express|diners|credit|karte|carte|tarjeta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ("-",), False, 0.4, r"ssn|social security|tax id"),
    Kind("local_phone", r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])", (), False, 0.4, r"tel|phone|call|fax|mobil"),
    Kind("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s\\]*+-----END [A-Z ]{0,30}PRIVATE KEY-----)?", ("-----BEGIN",), False, 1.0),
    # Public prefixes and lengths of access keys and tokens (AWS, GitHub, GitLab, Slack, Google, Stripe, npm; JSON web tokens).
    Kind(
        "access_key",
        r"(?<![A-Za-z0-9])(?=[Aegnrsx])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{50,90}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{10,80}"
        r"|AIza[A-Za-z0-9_-]{35}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,64}|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{8,2000}\.eyJ[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{16,1000})(?![A-Za-z0-9])",
        ("AKIA", "ASIA", "_", "glpat-", "xox", "AIza", "eyJ"), False, 0.9,
    ),
    Kind(
        "secret",
        r"(?i)(?<![a-z0-9])(?=[acpst])(?:api[_ -]?key|access[_ -]?key|auth[_ -]?token|token|secret|passw(?:or)?d|pwd|client[_ -]?secret|private[_ -]?key)[\"']?\s{0,3}(?:=|:|:=|=>)\s{0,3}[\"']?[a-z0-9+/_.=~-]{12,256}+",
        ("=", ":"), False, 0.8,
    ),
)
NEAR, CONTEXT_SCORE, LEAST, CHUNK = 40, 0.3, 0.6, 64
SPAN = "struct<kind:string,start:int,end:int,score:double>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of value pass the Luhn check."""
    each = F.split(F.reverse(digits(value)), "")
    weighed = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN's checksum holds: its first four characters moved to the end, letters read as 10 to 35."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    read = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), read) == 1


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind in ("card", "short_card"):
        return luhn(match)
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "secret":
        value = F.regexp_extract(match, r"[^\s\"':=>]+$", 0)
        # a name or a sentence is no secret: letters and digits, and as many different ones as chance gives
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def proposals(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, near>> of the pattern's leftmost matches; near: what stands beside, up to the next match.

    Everything comes from the pieces of one split, so that many matches in a long text do not each search it again.
    """
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,match:string,near:string>>")

    def step(seen: Column, part: Column) -> Column:
        start = seen["at"] + F.length(part["gap"])
        end = start + F.length(part["match"])
        near = F.concat(F.right(part["gap"], F.lit(NEAR)), F.lit(" "), F.left(part["next"], F.lit(NEAR)))
        return F.struct(end.alias("at"), F.array_append(seen["out"], F.struct(start.alias("start"), end.alias("end"), part["match"].alias("match"), near.alias("near"))).alias("out"))

    def placed(parts: Column) -> Column:
        """Matches with places, a chunk at a time, as appending to one long array would take quadratic time."""
        chunks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int"))
        chunk = lambda c: F.slice(parts, c * CHUNK + 1, F.lit(CHUNK))
        lengths = F.transform(chunks, lambda c: F.aggregate(chunk(c), F.lit(0), lambda a, p: a + F.length(p["gap"]) + F.length(p["match"])))

        def from_starts(sizes: Column) -> Column:
            start = lambda c: F.aggregate(F.slice(sizes, F.lit(1), c), F.lit(0), lambda a, n: a + n)
            return F.flatten(F.transform(chunks, lambda c: F.aggregate(chunk(c), F.struct(start(c).alias("at"), none.alias("out")), step, lambda seen: seen["out"])))

        return bound(lengths, from_starts)

    parts = bound(gaps, lambda g: F.arrays_zip(matches.alias("match"), F.slice(g, 1, F.size(g) - 1).alias("gap"), F.slice(g, 2, F.size(g)).alias("next")))
    return F.when(text.rlike(pattern), bound(parts, placed)).otherwise(none)


def spans(text: Column, kind: Kind) -> Column:
    """The kind's valid matches, with scores."""
    score = lambda m: F.when(F.lower(m["near"]).rlike(kind.context), kind.score + CONTEXT_SCORE).otherwise(kind.score) if kind.context else F.lit(kind.score)
    found = F.transform(
        F.filter(proposals(text, kind.pattern), lambda m: valid(kind.name, m["match"])),
        lambda m: F.struct(F.lit(kind.name).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.least(score(m), F.lit(1.0)).alias("score")),
    )
    none = F.array().cast(f"array<{SPAN}>")
    found = F.coalesce(found.cast(f"array<{SPAN}>"), none)
    return F.when(reduce(Column.__or__, (F.contains(text, F.lit(n)) for n in kind.needs)), found).otherwise(none) if kind.needs else found


def apart(more: Column, base: Column) -> Column:
    """The spans of ``more`` that overlap none of ``base``, in the order of KINDS and positions.

    All are sorted by start and cut into chunks: a span is held against its own chunk, the furthest end before that
    and the next start behind it, so that thousands of either kind do not take the product of their numbers.
    """
    order = {k.name: i for i, k in enumerate(KINDS)}
    rank = lambda s: F.element_at(F.create_map(*(x for k, v in order.items() for x in (F.lit(k), F.lit(v)))), s["kind"])
    event = lambda own: lambda s: F.struct(s["start"], s["end"], F.lit(own).alias("more"), rank(s).alias("rank"), s["kind"], s["score"])
    events = F.array_sort(F.concat(F.transform(more, event(True)), F.transform(base, event(False))))

    def chunked(every: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / CHUNK).cast("int")), lambda c: F.slice(every, c * CHUNK + 1, F.lit(CHUNK)))

        def bounds(c: Column) -> Column:
            own = F.filter(c, lambda s: ~s["more"])
            return F.struct(F.array_max(F.transform(own, lambda s: s["end"])).alias("end"), F.array_min(F.transform(own, lambda s: s["start"])).alias("start"))

        def settled(parts: Column) -> Column:
            def kept(limits: Column) -> Column:
                def one(c: Column, k: Column) -> Column:
                    before = F.coalesce(F.array_max(F.transform(F.slice(limits, F.lit(1), k), lambda x: x["end"])), F.lit(0))
                    behind = F.coalesce(F.array_min(F.transform(F.slice(limits, k + 2, F.size(limits)), lambda x: x["start"])), F.lit(2**31 - 1))
                    edges = F.struct(before.alias("before"), behind.alias("behind"))
                    clear = lambda s, e: s["more"] & (s["start"] >= e["before"]) & (s["end"] <= e["behind"]) & ~F.exists(c, lambda b: ~b["more"] & (b["start"] < s["end"]) & (s["start"] < b["end"]))
                    return bound(edges, lambda e: F.filter(c, lambda s: clear(s, e)))

                return F.flatten(F.transform(parts, one))

            return bound(F.transform(parts, bounds), kept)

        return bound(chunks, settled)

    found = F.array_sort(F.transform(bound(events, chunked), lambda s: F.struct(s["rank"], s["start"], s["end"], s["kind"], s["score"])))
    out = F.transform(found, lambda s: F.struct(s["kind"], s["start"], s["end"], s["score"]))
    return F.when((F.size(more) == 0) | (F.size(base) == 0), more).otherwise(out)


def with_spans(docs: DataFrame, text_col: str = "text", least: float = LEAST, into: str = "spans", base_into: str = "base_spans") -> DataFrame:
    """docs with two arrays of spans in the order of KINDS and positions: all that are reported, and those of the base kinds."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.withColumn(base_into, F.concat(*(spans(text, k) for k in KINDS if k.base)))
    docs = docs.withColumn(into, F.filter(F.concat(*(spans(text, k) for k in KINDS if not k.base)), lambda s: s["score"] >= least))
    return docs.withColumn(into, F.concat(F.col(base_into), apart(F.col(into), F.col(base_into))))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """A row for each document: its id, spans and base_spans."""
    return with_spans(docs.select(F.col(id_col), F.col(text_col).alias("text")), "text", least).drop("text")


def redacted(docs: DataFrame, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """docs with each reported span of the text replaced by its kind in brackets."""
    found = with_spans(docs, text_col, least, "__spans", "__base")
    ordered = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(seen: Column, s: Column) -> Column:
        piece = F.concat(seen["out"], F.substring(F.col(text_col), seen["at"] + 1, s["start"] - seen["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] < seen["at"], seen).otherwise(F.struct(s["end"].alias("at"), piece.alias("out")))

    text = F.aggregate(ordered, start, step, lambda seen: F.concat(seen["out"], F.substring(F.col(text_col), seen["at"] + 1, F.length(text_col))))
    return found.withColumn(text_col, F.when(F.size("__spans") > 0, text).otherwise(F.col(text_col))).drop("__spans", "__base")
