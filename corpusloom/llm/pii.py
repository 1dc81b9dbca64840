"""Personal data: exact patterns, wider candidate generators, boosted trees over their features.

Everything is built from column expressions and Spark ML; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import write_scratch

KINDS = ("email", "ip", "card", "phone")

# Possessive forms of the fixed patterns: nothing follows that could need a shorter match, and no
# run of characters is read again from each of its positions. \G lets a match begin where the one
# before it ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without a match of its hint has no match of the pattern.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": "+"}

# High recall, bounded repetition: what looks like the kind at a glance.
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?(?:@|[(\[]at[)\]])\x20?[a-z0-9-]{1,63}"
    r"(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[a-z0-9-]{1,63}){0,4}",
    "ip": r"(?<![0-9A-Za-z.:])(?:[0-9]{1,4}(?:\x20?[.,]\x20?[0-9]{1,4}){3}|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{3,6}(?:[\x20._-]?[0-9]{3,6}){2,5}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\+|00)\x20?)?[(]?[0-9]{1,4}[)]?(?:[\x20.-]?[(]?[0-9]{2,4}[)]?){2,5}(?![0-9A-Za-z])",
}
_WIDE_HINT = {
    "email": r"@|[(\[][aA][tT][)\]]",
    "ip": r"[0-9]\x20?[.,]\x20?[0-9]|:[0-9A-Fa-f]{1,4}:",
    "card": r"[0-9]{3}[\x20._-]?[0-9]{3}",
    "phone": r"[0-9][)]?[\x20.-]?[(]?[0-9]{2}",
}
# Every match of any pattern here holds one of these.
_ANY = r"[0-9@]|[(\[][aA][tT][)\]]"
_CUES = (
    r"(?i)mail|write to|contact",
    r"(?i)\bip\b|address|server|host",
    r"(?i)card|visa|master|payment|account",
    r"(?i)phone|call|tel|fax|mobile|dial",
)
# Words directly before a number that say it is something else.
_CONTRARY = (
    r"(?i)(?:\b(?:orders?|invoice|items?|parts?|version|release|isbn|issn|serial|pages?|chapter|section|years?|dated?|since|total|"
    r"prices?|sum|figure|table|ref|reference|ticket|code)\b(?:[ ]?(?:no|nr|id|number)\b)?|[$€£#])[^0-9A-Za-z]{0,3}$"
)
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class PiiParams:
    """``precision`` a kind's threshold must reach on the calibration rows, ``trees`` of ``depth``."""

    precision: float = 0.95
    least: int = 20
    trees: int = 8
    depth: int = 3


def _let(value: Column, body) -> Column:
    """``body`` of ``value`` as a variable. What stands inside a lambda is computed anew for each
    element unless it is one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _prefix_sums(values: Column) -> Column:
    """Sums of the elements before each one and of all; quadratic, for short arrays."""
    step = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    return F.aggregate(values, F.array(F.lit(0)), step)


def _blocks(values: Column) -> Column:
    """An array in about as many consecutive parts as a part has elements."""

    def cut(array: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(array))).cast("int"))
        last = F.floor((F.size(array) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(array, b * size + 1, size))

    return _let(values, cut)


def _starts(lengths: Column) -> Column:
    """Where each of some consecutive pieces starts, block by block so that many pieces are cheap."""
    total = lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x)
    placed = lambda block, before: F.transform(F.slice(_prefix_sums(block), 1, F.size(block)), lambda x: x + before)

    def in_blocks(blocks: Column) -> Column:
        return _let(
            _prefix_sums(F.transform(blocks, total)),
            lambda totals: F.flatten(F.transform(blocks, lambda block, b: placed(block, F.get(totals, b)))),
        )

    return _let(_blocks(lengths), in_blocks)


def _matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, value, before, after>>`` of a pattern's matches, with the text's
    last characters before and first ones after each."""
    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")
    )

    def described(r: Column, starts: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            gap = F.get(r["gaps"], i)
            start = F.get(starts, i) + F.length(gap)
            return F.struct(
                start.alias("start"),
                (start + F.length(hit)).alias("end"),
                hit.alias("value"),
                F.right(gap, F.lit(24)).alias("before"),
                F.substring(F.get(r["gaps"], i + 1), 1, 1).alias("after"),
            )

        return F.transform(r["hits"], one)

    def placed(r: Column) -> Column:
        lengths = F.zip_with(r["gaps"], r["hits"], lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))
        spans = _let(_starts(lengths), lambda starts: described(r, starts))
        return F.when(F.size(r["hits"]) > 0, spans).otherwise(found_nothing())

    return _let(found, placed)


def found_nothing() -> Column:
    return F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn check on a text of digits."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _hinted(text: Column, hint: str) -> Column:
    return text.contains(hint) if len(hint) == 1 else text.rlike(hint)


def base_spans(text: Column) -> Column:
    """``array<struct<kind, start, end>>`` of the exact patterns, in the order of ``KINDS``, then by
    start; ``kind`` is a number. Positions are code points, ends exclusive."""
    arrays = []
    for number, kind in enumerate(KINDS):
        spans = _spans(number, kind, text)
        arrays.append(F.when(_hinted(text, HINT[kind]), spans).otherwise(_no_spans()))
    return F.when(text.rlike(_ANY), F.concat(*arrays)).otherwise(_no_spans())


def _spans(number: int, kind: str, text: Column) -> Column:
    valid = F.filter(_matches(text, BASE[kind]), lambda m: _valid(kind, m["value"]))
    return F.transform(
        valid, lambda m: F.struct(F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    )


def _no_spans() -> Column:
    return F.array().cast("array<struct<kind:int,start:int,end:int>>")


def _bucket(value: Column, *cuts: int) -> Column:
    out = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        out = F.when(value <= cut, F.lit(i)).otherwise(out)
    return out


FEATURES = ("kind", "digits", "seps", "letters", "groups", "mark", "cue", "left", "right", "check")


def _features(number: int, m: Column) -> Column:
    """Format and context of a candidate as small numbers written in one text.

    Their combinations are the rows that trees are trained on: at most 4 * 7 * 4 * 3 * 5 * 4 * 3 *
    4 * 3 * 2 = 483,840, whatever the corpus. A leading plus sign is no feature.
    """
    value = m["value"]
    count = lambda of: F.length(value) - F.length(F.regexp_replace(value, of, ""))
    side = lambda c: F.when(c == "", 0).when(c.rlike(r"[ \t-\r]"), 1).when(c.rlike(r"[.,;:!?()\"']"), 2)
    last = F.right(m["before"], F.lit(1))
    parts = (
        F.lit(number),
        _bucket(count("[0-9]"), 0, 4, 8, 9, 12, 15),
        _bucket(count(r"[ ._(),:-]"), 0, 2, 4),
        _bucket(count("[A-Za-z]"), 0, 8),
        _bucket(F.size(F.split(value, "[^0-9A-Za-z]+")), 1, 2, 3, 4),
        F.when(value.contains("@"), 2).when(value.rlike(r"[(\[]"), 1).when(value.contains(","), 3).otherwise(0),
        F.when(m["before"].rlike(_CONTRARY), 2).when(m["before"].rlike(_CUES[number]), 1).otherwise(0),
        F.coalesce(side(last), F.lit(3)),
        F.least(F.coalesce(side(m["after"]), F.lit(2)), F.lit(2)),
        F.when(_plausible(number, value), 1).otherwise(0),
    )
    return F.concat_ws("|", *(p.cast("string") for p in parts))


def _plausible(number: int, value: Column) -> Column:
    """Whether the parts of a candidate fit its kind, whatever stands between them."""
    if KINDS[number] == "email":
        return value.rlike(r"(?i)(?:\.|[(\[]dot[)\]])\x20?[a-z]{2,63}$") & value.rlike("^.*[A-Za-z].*(?:@|[\\[(])")
    if KINDS[number] == "ip":
        four = rf"^{_BYTE}(?:\x20?[.,]\x20?{_BYTE}){{3}}$"
        return value.rlike(four) | value.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$")
    return _valid(KINDS[number], value)


# Made-up personal data to learn from where a corpus shows none, and what stands before it.
_SEEDS = (
    ("jane.doe@mail.example.org", "info@firm.com", "m_k77@uni.edu", "sales@shop.co.uk", "bob@host.net", "a.b.c@dept.uni.edu", "x1@y2.org", "team-9@site.io"),
    (
        "192.0.2.17", "10.1.22.5", "203.0.113.200", "172.16.4.4", "8.8.4.4", "198.51.100.23", "127.0.0.1", "100.64.12.250",
        "10.0.0.8", "192.168.178.20", "169.254.3.77", "203.0.113.9", "172.31.255.254", "1.2.3.4", "198.18.0.61", "192.88.99.1",
    ),
    (
        "4111111111111111", "5500005555555559", "4012 8888 8888 1881", "6011-1111-1111-1117", "5555555555554444", "4242424242424242",
        "6011000990139424", "3530111333300000", "5105105105105100", "4000056655665556", "378282246310005",
    ),
    (
        "+1 (415) 555-0100", "+44 20 7946 0958", "+49 30 1234567", "+1 586 555 8430", "+33 1 23 45 67 89", "+1-212-555-0199",
        "+1 (702) 555-0143", "+44 7700 900123", "+34 912 345 678", "+1 303 555 0172", "+1 (617) 555-0121", "+49 89 9876543",
    ),
)
_SAID = (("write to ", "my mail: "), ("server ", "ip address: "), ("card: ", "visa "), ("call me: ", "phone "))
_ELSE = ("order ", "invoice no. ", "version ", "item #")
_NUMBERS = (
    ("10 @ 5", "lunch @ noon", "3 @ 99", "see @ home"),
    ("999.300.1.1", "1, 2, 3, 4", "1000, 2000, 3000, 4000", "12:30:45:10", "00:1a:2b:3c:4d:5e", "2024.1.15.300"),
    ("123.456.789", "100 200 300 400", "2024.1015.2023", "123456789012345", "978 316 148410", "1000 2000 3000 5000"),
    ("2024-01-15", "15.01.2024", "1 000 000", "100 200 300 400", "123.456.789", "1990 1991 1992 1993", "12 34 56", "0-316-14841-4"),
)


def _variants(number: int, value: Column) -> tuple[Column, ...]:
    """Forms of a base span that the exact pattern does not know."""
    if KINDS[number] == "email":
        name, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
        dotted = lambda dot: F.regexp_replace(host, r"[.]", dot)
        return (
            F.concat(name, F.lit(" [at] "), dotted(" [dot] ")), F.concat(name, F.lit("(at)"), host),
            F.concat(name, F.lit(" (at) "), dotted(" (dot) ")), F.concat(name, F.lit(" @ "), host),
        )
    if KINDS[number] == "ip":
        return F.regexp_replace(value, r"[.]", " . "), F.regexp_replace(F.md5(value), "(.{4})(?=.)", "$1:")
    digits = _digits(value)
    if KINDS[number] == "card":
        return tuple(F.regexp_replace(digits, "(.{4})(?=.{3})", f"$1{mark}") for mark in "._")
    ten = F.lpad(F.right(digits, F.lit(10)), 10, "2")
    grouped = (F.regexp_replace(ten, "^(...)(...)(....)$", to) for to in ("($1) $2-$3", "($1)$2-$3", "$1-$2-$3", "$1.$2.$3", "$1 $2 $3"))
    return *grouped, F.regexp_replace(value, "^[+]", ""), F.regexp_replace(value, "^[+]", "00")


def _lessons(number: int, seen: Column) -> Column:
    """``array<struct<value, before, after, label>>`` made from a base span and its context.

    Right (1) are its variants, in the span's own context and where a word of the kind stands
    before. Wrong (0) are the same digits where another word stands before, the variants with one
    digit altered where there is a check digit, and numbers of other kinds in any of these places.
    """
    own, after = seen["before"], seen["after"]
    here = lambda v, before, y: F.struct(v.alias("value"), before.alias("before"), after.alias("after"), y.alias("label"))
    places = [own, *(F.lit(b) for b in _SAID[number])]
    variants = _variants(number, seen["value"])
    rows = [here(v, b, F.when(b.rlike(_CONTRARY), 0).otherwise(1)) for v in variants for b in places]
    rows += [here(F.lit(v), b, F.lit(0)) for v in _NUMBERS[number] for b in (*places, F.lit(_ELSE[0]))]
    if KINDS[number] != "email":
        rows += [here(v, F.lit(b), F.lit(0)) for v in variants for b in _ELSE]
    if KINDS[number] == "card":
        altered = lambda v: F.concat(F.translate(F.left(v, F.lit(1)), "0123456789", "1234567890"), F.substr(v, F.lit(2)))
        rows += [here(altered(v), b, F.lit(0)) for v in (seen["value"], *variants) for b in places]
    return F.array(*rows)


def _seen(text: Column, base: Column) -> Column:
    """``array<struct<kind, value, before, after>>``: every base span of a text, with its context."""
    def cut(own: Column, begin: Column, b: Column) -> Column:
        before = F.greatest(b["start"] - 24, F.lit(0))
        return F.struct(
            b["kind"].alias("kind"),
            F.substr(own, b["start"] - begin + 1, b["end"] - b["start"]).alias("value"),
            F.substr(own, before - begin + 1, b["start"] - before).alias("before"),
            F.substr(own, b["end"] - begin + 1, F.lit(1)).alias("after"),
        )

    def part(block: Column) -> Column:
        # A block's own stretch of the text, so that a long text is not read from its start for each span.
        begin = F.greatest(F.get(block, 0)["start"] - 24, F.lit(0))
        own = F.substr(text, begin + 1, F.element_at(block, -1)["end"] + 1 - begin)
        held = F.struct(own.alias("own"), begin.alias("begin"))
        return _let(held, lambda v: F.transform(block, lambda b: cut(v["own"], v["begin"], b)))

    def of(number: int) -> Column:
        spans = F.filter(base, lambda b: b["kind"] == number)
        none = F.array().cast("array<struct<kind:int,value:string,before:string,after:string>>")
        cuts = _let(_blocks(spans), lambda blocks: F.flatten(F.transform(blocks, part)))
        return F.when(F.size(spans) > 0, cuts).otherwise(none)

    return F.concat(*(of(number) for number in range(len(KINDS))))


def candidates(text: Column, base: Column) -> Column:
    """``array<struct<kind, start, end, vec, free>>`` of the wide patterns; ``free`` if a candidate
    touches no base span.
    """
    arrays = []
    for number, kind in enumerate(KINDS):
        wide = F.transform(_matches(text, WIDE[kind]), _described(number, base))
        none = F.array().cast("array<struct<kind:int,start:int,end:int,vec:string,free:boolean>>")
        arrays.append(F.when(text.rlike(_WIDE_HINT[kind]), wide).otherwise(none))
    return F.when(text.rlike(_ANY), F.concat(*arrays)).otherwise(none)


def _described(number: int, base: Column):
    def described(m: Column) -> Column:
        touched = F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
        return F.struct(
            F.lit(number).alias("kind"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            _features(number, m).alias("vec"),
            (~touched).alias("free"),
        )

    return described


def accepted_vectors(found: DataFrame, params: PiiParams) -> list[str]:
    """The feature combinations whose candidates are redacted.

    ``_lessons`` of all base spans and of ``_SEEDS`` are counted by combination; spans that agree in
    value and context make theirs once and count as often as they occur. Candidates of the corpus have
    no label. For each kind trees are boosted on one half of the lessons, by the text
    they come from, and calibrated on the other: a kind's threshold is the lowest score above which
    ``params.precision`` of at least ``params.least`` lessons are right. No such score: nothing of
    the kind is added.
    """
    spark = found.sparkSession
    seeds = [(i % 2, number, value, "", "") for number, values in enumerate(_SEEDS) for i, value in enumerate(values)]
    base = found.select("half", F.explode("seen").alias("s")).select("half", "s.*").unionByName(
        spark.createDataFrame(seeds, "half long, kind int, value string, before string, after string")
    )
    base = base.groupBy("half", "kind", "value", "before", "after").agg(F.count(F.lit(1)).alias("times"))
    seen = F.struct("value", "before", "after")
    by_kind = lambda of: F.coalesce(*(F.when(F.col("kind") == n, of(n)) for n in range(len(KINDS))))
    made = base.select("half", "kind", "times", F.explode(by_kind(lambda n: _lessons(n, seen))).alias("m"))
    whole = by_kind(lambda n: F.col("m.value").rlike(rf"^(?:{WIDE[KINDS[n]]})$"))
    vec = by_kind(lambda n: _features(n, F.col("m")))
    rows = made.filter(whole).select("half", vec.alias("vec"), "m.label", "times", F.lit(0).alias("real"))
    real = found.select("half", F.explode("cands").alias("c")).filter("c.free")
    rows = rows.unionByName(real.select("half", "c.vec", F.lit(None).cast("int").alias("label"), F.lit(1).alias("times"), F.lit(1).alias("real")))
    counted = lambda h, y: F.sum(F.when((F.col("half") == h) & (F.col("label") == y), F.col("times")).otherwise(0))
    vectors = rows.groupBy("vec").agg(
        *(counted(h, y).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1)),
        F.max("real").alias("real"),
    )
    split = F.split("vec", "[|]")
    vectors = vectors.select("vec", "real", "n00", "n01", "n10", "n11", *(split[i].cast("double").alias(f) for i, f in enumerate(FEATURES)))
    vectors = write_scratch(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(vectors), "candidate-kinds")
    labels = F.explode(F.array(*(F.struct(F.lit(float(y)).alias("label"), F.col(f"n0{y}").cast("double").alias("weight")) for y in (0, 1))))
    parts = []
    for number in range(len(KINDS)):
        own = vectors.filter(F.col("kind") == number)
        training = own.select("features", labels.alias("r")).select("features", "r.label", "r.weight").filter("weight > 0").coalesce(1)
        model = GBTClassifier(maxIter=params.trees, maxDepth=params.depth, weightCol="weight", seed=1).fit(training)
        parts.append(model.transform(own).select(
            "vec", "real", F.col("kind").cast("int").alias("kind"), F.round(vector_to_array("probability")[1], 9).alias("p"), "n10", "n11"
        ))
    scored = reduce(DataFrame.unionByName, parts)
    scored = write_scratch(scored, "candidate-scores")
    above = Window.partitionBy("kind").orderBy(F.desc("p")).rangeBetween(Window.unboundedPreceding, 0)
    right, all_ = F.sum("n11").over(above), F.sum(F.col("n10") + F.col("n11")).over(above)
    cut = (
        scored.withColumns({"right": right, "all": all_})
        .filter((F.col("all") >= params.least) & (F.col("right") >= params.precision * F.col("all")))
        .groupBy("kind")
        .agg(F.min("p").alias("cut"))
    )
    return sorted(r["vec"] for r in scored.join(F.broadcast(cut), "kind").filter("p >= cut AND real = 1").select("vec").collect())


def find_pii(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """The columns of ``docs`` but for ``text``, with ``base`` and ``added`` spans of whole texts.

    Both are ``array<struct<kind, start, end>>`` with ``kind`` an index of ``KINDS``. Added spans
    touch no base span and no added span of an earlier kind. A null text counts as empty and has no
    spans; repeated rows are treated alike; an empty table gives an empty result. Columns of these
    names that ``docs`` has are replaced.
    """
    keep = [c for c in docs.columns if c not in ("text", "base", "added")]
    found, base, added = _judged(docs, keep, params, False)
    return found.select(*(F.col("row").getField(c).alias(c) for c in keep), base.alias("base"), added.alias("added"))


def _judged(docs: DataFrame, keep: list[str], params: PiiParams, with_text: bool):
    """Rows with ``row``, a struct of the columns to keep, and with ``text`` if asked for; the columns
    of base and of added spans.

    A row's own columns travel in that struct, so that none can clash with those worked out here.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(F.lit(0).alias("#"), *(F.col(c) for c in keep))
    staged = docs.select(row.alias("row"), F.col("text").alias("text")).withColumn("base", base_spans(text))
    staged = staged.withColumns(
        {"cands": candidates(text, F.col("base")), "seen": _seen(text, F.col("base")), "half": F.pmod(F.xxhash64("text"), F.lit(2))}
    )
    found = write_scratch(staged if with_text else staged.drop("text"), "candidates")
    good = accepted_vectors(found, params)
    chosen = F.filter("cands", lambda c: c["free"] & c["vec"].isin(good)) if good else F.slice("cands", 1, 0)
    spans = F.transform(chosen, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    found = found.withColumn("added", spans)
    earlier = lambda s: F.exists(
        F.col("added"), lambda o: (o["kind"] < s["kind"]) & (o["start"] < s["end"]) & (s["start"] < o["end"])
    )
    return found, F.col("base"), F.filter("added", lambda s: ~earlier(s))


def written(spans: Column) -> Column:
    """``kind:start:end`` by kind, then start, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.array_sort(spans)
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one.

    ``spans`` is ``array<struct<kind, start, end>>``. Spans are taken in blocks of about the square
    root of their number, so that a long text with many is not copied once for each.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # A span that begins inside an earlier one only lengthens it.
    merge = lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]),
        F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(
                F.element_at(acc, -1)["start"].alias("start"),
                F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                F.element_at(acc, -1)["kind"].alias("kind"),
            )),
        ),
    ).otherwise(F.concat(acc, F.array(s)))
    empty = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    return F.when(F.size(spans) == 0, text).otherwise(_rebuilt(text, F.aggregate(ordered, empty, merge)))


def _rebuilt(text: Column, spans: Column) -> Column:
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def replaced(own: Column, block: Column, begin: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            at = F.when(i == 0, begin).otherwise(F.get(block, i - 1)["end"])
            return F.concat(F.substr(own, at - begin + 1, s["start"] - at), F.get(names, s["kind"]))

        return F.array_join(F.transform(block, one), "")

    def joined(blocks: Column) -> Column:
        def part(block: Column, b: Column) -> Column:
            begin = F.when(b == 0, 0).otherwise(F.element_at(F.get(blocks, b - 1), -1)["end"])
            own = F.substr(text, begin + 1, F.element_at(block, -1)["end"] - begin)
            return _let(F.struct(own.alias("own"), begin.alias("begin")), lambda v: replaced(v["own"], block, v["begin"]))

        end = F.element_at(F.element_at(blocks, -1), -1)["end"]
        return F.concat(F.array_join(F.transform(blocks, part), ""), F.substr(text, end + 1, F.length(text)))

    return _let(_blocks(spans), joined)


def redact_documents(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """``docs`` with all spans of ``find_pii`` replaced in ``text``, and ``n_chars`` renewed.

    A null text stays null; nulls, repeats and empty tables are treated as there.
    """
    own = [c for c in docs.columns if c != "text"]
    found, base, _ = _judged(docs, own, params, True)
    found = found.withColumn("text", redact(F.col("text"), F.concat(base, F.col("added"))))
    new = {"text": F.col("text")}
    if "n_chars" in own:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))
