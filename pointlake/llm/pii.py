"""Personal data by candidate gradient boosting, in built-in functions only.

High-recall generators propose spans of four kinds, overlaps included. Spans in a base format are
always kept. The others are scored by boosted trees over format and context features; a candidate
is redacted when its score reaches its kind's threshold, calibrated on labelled rows that the trees
did not see, and no better candidate overlaps it.

Everything stays within the row: no join, no shuffle. Digits are first cut out as runs of digits
and separators, so that the other patterns only see short strings. Patterns begin only at the start
of a run (or where the last match ended) and are possessive, so they are linear in the text.

The trees are fitted on at most LABELLED rows of labelled text that this module writes itself from
formats and counter-examples with a fixed seed; the rows go through the same generators.

Edge cases: a null text is empty and has no spans; positions count code points; repeated rows get
equal results; very long texts are searched whole, in linear time; all columns of the input pass
through, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, numbered, renamed

KINDS = ("email", "ip", "card", "phone")
#: The most labelled rows that the trees are fitted on.
LABELLED = 2400
TREES, DEPTH, RATE, PRECISION = 24, 3, 0.3, 0.97

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Runs of digits and separators that hold seven digits or three inner dots; the latter may follow a plus.
RUN = (
    r"(?:(?:\G|(?<![0-9+]))(?=\(?\+?(?:[\x20().+/-]*+[0-9]){7}|\(?[0-9]++\.[0-9]++\.[0-9]++\.[0-9])"
    r"|(?<=\+)(?=[0-9]++\.[0-9]++\.[0-9]++\.[0-9]))\(?[0-9+][0-9\x20().+/-]*+"
)
OPEN_CARD = r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){12,18}(?![0-9])"
OPEN_PHONE = r"(?<![0-9])(?:\+\x20?)?(?:\([0-9]{1,5}\)|[0-9]{1,5})(?:[\x20./-]{1,3}\(?[0-9]{2,8}\)?){1,6}(?![0-9])|(?<![0-9])[0-9]{10,11}(?![0-9])"
OPEN_IP = r"(?<![0-9])[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\.)\x20?[0-9]{1,3}){3}(?![0-9])"
OPEN_EMAIL = (
    r"(?i)(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}(?:\x20?(?:@|[\[({<]at[\])}>])\x20?|\x20at\x20)[\p{L}\p{N}-]{1,63}"
    r"(?:(?:\.|\x20?[\[({<]dot[\])}>]\x20?|\x20(?:dot|punkt|punto)\x20)[\p{L}\p{N}-]{1,63}){1,4}"
)
FEATURES = ("kind", "digits", "groups", "seps", "dots", "parens", "luhn", "octets", "glued", "hint", "against", "date", "size", "last", "zero", "marks", "slashes", "years", "zeros")
_HINT = (r"(?i)(mail|contact|write|kontakt|correo|courriel)", r"(?i)(\bip\b|host|server|address|addr|ping|from)", r"(?i)(card|visa|credit|amex|master|payment|karte|carte|tarjeta|\bcc\b)", r"(?i)(phone|tel|call|mobile|fax|cell|whatsapp|sms|\bring\b|mobil|handy)")
_AGAINST = r"(?i)(order|invoice|isbn|issn|version|\bv\b|page|serial|item|sku|ref|\bid\b|total|sum|price|lines|pi\b|ratio|year|date|section|build|room|score|between)"


def running(x: Column) -> Column:
    """Exclusive running sums of an array of ints, in blocks of 64, so that no long array is built by appending."""
    empty = F.array().cast("array<int>")
    add = lambda acc, v: F.struct((acc["t"] + v).alias("t"), F.concat(acc["o"], F.array(acc["t"])).alias("o"))
    zero = F.struct(F.lit(0).alias("t"), empty.alias("o"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 64).cast("int")), lambda b: F.aggregate(F.slice(x, b * 64 + 1, F.lit(64)), zero, add))
    starts = F.aggregate(blocks, zero, lambda acc, b: F.struct((acc["t"] + b["t"]).alias("t"), F.concat(acc["o"], F.array(acc["t"])).alias("o")))["o"]
    return F.flatten(F.zip_with(blocks, starts, lambda b, o: F.transform(b["o"], lambda y: y + o)))


def find(text: Column, pattern: str, before: Column | None = None, after: Column | None = None) -> Column:
    """All matches as array<struct<s, m, before, after>>: place, match, and what surrounds it."""
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"))
    before, after = F.lit("") if before is None else before, F.lit("") if after is None else after

    def place(p: Column) -> Column:
        gaps, found = p["gaps"], p["found"]
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))

        def item(at: Column, i: Column) -> Column:
            gap, then = F.get(gaps, i), F.get(gaps, i + 1)
            left = F.when(i == 0, F.concat(before, gap)).otherwise(gap)
            right = F.when(i == F.size(found) - 1, F.concat(then, after)).otherwise(then)
            return F.struct((at + F.length(gap)).alias("s"), F.get(found, i).alias("m"), F.substring(left, -24, 24).alias("before"), F.substring(right, 1, 2).alias("after"))

        return F.when(F.size(found) > 0, F.transform(running(steps), item)).otherwise(F.array().cast("array<struct<s:int,m:string,before:string,after:string>>"))

    return F.flatten(F.transform(F.array(parts), place))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def luhn(d: Column) -> Column:
    """Luhn's check of a string of digits."""
    turned = F.reverse(d)
    value = lambda i: F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), lambda t, i: t + F.when(value(i) > 9, value(i) - 9).otherwise(value(i)))
    return (F.length(d) > 0) & (total % 10 == 0)


def octets(m: Column) -> Column:
    """Whether every number in it is at most 255."""

    def fits(x: Column) -> Column:
        bare = F.regexp_replace(x, "^0+", "")
        return (F.length(bare) <= 3) & (F.substring(F.concat(F.lit("000"), bare), -3, 3).cast("int") <= 255)

    return F.forall(F.regexp_extract_all(m, F.lit("[0-9]+"), 0), fits)


def _plain(x: Column, kind: int, base: bool, shift: Column | None = None) -> Column:
    at = x["s"] if shift is None else x["s"] + shift
    return F.struct(F.lit(kind).alias("kind"), at.alias("s"), (at + F.length(x["m"])).alias("e"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"), F.lit(base).alias("base"))


def _marked(kind: int, base: bool, shift: Column) -> Callable[[Column], Column]:
    return lambda x: _plain(x, kind, base, shift)


_NONE = "array<struct<kind:int,s:int,e:int,m:string,before:string,after:string,base:boolean>>"


def candidates(text: Column) -> Column:
    """Base spans and proposals of a text, as an array of structs."""
    none = F.array().cast(_NONE)
    n = lambda m: F.length(digits(m))
    has = lambda c, *xs: reduce(or_, (F.contains(c, F.lit(x)) for x in xs))

    email = F.when(F.contains(text, F.lit("@")), F.transform(find(text, EMAIL), lambda x: _plain(x, 0, True))).otherwise(none)
    low = F.lower(text)
    spelt = has(low, "@") | (has(low, "dot", ".", " punkt ", " punto ") & has(low, "[at]", "(at)", "{at}", "<at>", " at ") & has(low, "[at]", "(at)", "{at}", "<at>", " dot ", " punkt ", " punto "))
    open_email = F.when(spelt, F.transform(find(text, OPEN_EMAIL), lambda x: _plain(x, 0, False))).otherwise(none)
    open_ip = F.when(has(low, "[.]", "(.)", "[dot]", "(dot)", " . "), F.transform(find(text, OPEN_IP), lambda x: _plain(x, 1, False))).otherwise(none)

    def inside(run: Column) -> Column:
        body = run["m"]
        look = lambda p: find(body, p, run["before"], run["after"])
        ip = F.filter(look(IP), lambda x: octets(x["m"]))
        card = F.filter(look(CARD), lambda x: n(x["m"]).between(16, 19) & luhn(digits(x["m"])))
        phone = F.filter(look(PHONE), lambda x: n(x["m"]).between(8, 15))
        more_card = F.filter(look(OPEN_CARD), lambda x: n(x["m"]).between(13, 19))
        more_phone = F.filter(look(OPEN_PHONE), lambda x: n(x["m"]).between(7, 15))
        sets = ((ip, 1, True), (card, 2, True), (phone, 3, True), (more_card, 2, False), (more_phone, 3, False))
        return F.concat(*[F.transform(c, _marked(k, b, run["s"])) for c, k, b in sets])

    runs = F.when(text.rlike("[0-9]"), find(text, RUN)).otherwise(F.array().cast("array<struct<s:int,m:string,before:string,after:string>>"))
    return F.concat(email, F.flatten(F.transform(runs, inside)), open_email, open_ip)


def _unique(x: Column) -> Column:
    """Proposals that overlap no base span."""
    base = F.filter(x, lambda c: c["base"])
    return F.filter(x, lambda c: ~c["base"] & ~F.exists(base, lambda b: (b["s"] < c["e"]) & (b["e"] > c["s"])))


def features(c: Column) -> dict[str, Column]:
    m, d = c["m"], digits(c["m"])
    flag = lambda x: x.cast("int")
    hints = F.lit(False)
    for k, p in enumerate(_HINT):
        hints = F.when(c["kind"] == k, c["before"].rlike(p)).otherwise(hints)
    # The last label of an address, or the digits of the last group.
    last = F.regexp_extract(m, r"([\p{L}\p{N}]+)\)?$", 1)
    return {
        "kind": c["kind"],
        "digits": F.length(d),
        "groups": F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), 0)),
        "seps": F.length(F.regexp_replace(m, r"[^\x20-]+", "")),
        "dots": F.length(F.regexp_replace(m, r"[^.]+", "")),
        "parens": F.length(F.regexp_replace(m, r"[^()\[\]{}<>]+", "")),
        "luhn": flag(luhn(d)),
        "octets": flag(octets(m)),
        "glued": flag(c["before"].rlike(r"[\p{L}\p{N}_/.,-]$")) + flag(c["after"].rlike(r"^([\p{L}\p{N}_/%]|[.,-][0-9])")),
        "hint": flag(hints),
        "against": flag(c["before"].rlike(_AGAINST)),
        "date": flag(m.rlike(r"(?:^|[^0-9])(?:(?:19|20)[0-9]{2}[-./\x20](?:0?[1-9]|1[0-2])[-./\x20](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[-./\x20](?:0?[1-9]|[12][0-9]|3[01])[-./\x20](?:19|20)[0-9]{2})(?:[^0-9]|$)|^(?:19|20)[0-9]{2}[\x20-]+(?:19|20)[0-9]{2}")),
        "size": F.length(m),
        "last": F.length(last),
        "zero": flag(m.rlike(r"^\(?0")),
        "marks": flag(m.rlike(r"(?i)(@|[\[({<](at|dot)[\])}>]|\[\.\]|\x20(?:dot|punkt|punto)\x20)")),
        "slashes": F.length(F.regexp_replace(m, "[^/]+", "")),
        "years": F.size(F.regexp_extract_all(m, F.lit(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"), 0)),
        "zeros": F.length(F.regexp_replace(d, "[^0]+", "")),
    }


# --- the trees ---


def fit_tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree for gradients g and curvatures h: (feature, threshold, left, right) or a value."""
    best = None
    if depth and len(x) >= 8:
        total = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            for t in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= t
                if 4 <= left.sum() <= len(x) - 4:
                    gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - total
                    if gain > 1e-6 and (best is None or gain > best[0]):
                        best = (gain, f, int(t), left)
    if best is None:
        return float(g.sum() / (h.sum() + 1))
    _, f, t, left = best
    return (f, t, fit_tree(x[left], g[left], h[left], depth - 1), fit_tree(x[~left], g[~left], h[~left], depth - 1))


def tree_value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, a, b = tree
    return np.where(x[:, f] <= t, tree_value(a, x), tree_value(b, x))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> list:
    out, score = [], np.zeros(len(x))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = fit_tree(x, y - p, p * (1 - p), depth)
        out.append(tree)
        score += rate * tree_value(tree, x)
    return out


def calibrate(score: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The least threshold, of a probability of 1/2 at least, from which on the share of true spans is
    at least ``precision``; infinite if none."""
    for t in np.unique(score[score >= 0]):
        if y[score >= t].mean() >= precision:
            return float(round(t, 6)) - 1e-6
    return float("inf")


def tree_column(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, t, a, b = tree
    return F.when(c[FEATURES[f]] <= t, tree_column(a, c)).otherwise(tree_column(b, c))


def labelled_rows(n: int = LABELLED, seed: int = 5) -> list[dict]:
    """Texts with one marked span (start, end, truth) each, written from formats and counter-examples."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexed = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "ter", "lo", "mi", "ou", "re", "st", "en", "ka", "di")) for _ in range(r.randint(1, 4)))

    def card(k: int) -> str:
        body = r.choice("3456") + num(k - 2)
        total = sum(v if i % 2 else (2 * v - 9 * (v > 4)) for i, v in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    def spread(d: str, sizes, sep: str) -> str:
        out, at = [], 0
        for k in sizes:
            out.append(d[at : at + k])
            at += k
        return sep.join(out)

    tld = lambda: r.choice(("com", "org", "net", "de", "fr", "example", "io", "co.uk"))
    octet = lambda: str(r.choice((r.randint(0, 255), r.randint(0, 255), r.randint(0, 9), 10)))
    true = [
        (("phone", "tel", "call", "fax", "", "", "at"), lambda: r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)} {num(3)} {num(4)}", f"1-{num(3)}-{num(3)}-{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"00{num(2)} {num(2)} {num(7)}", f"0{num(4)} {num(6)}", f"+ {num(2)} {num(3)} {num(6)}", f"0{num(3)}/{num(7)}", f"0{num(2)}/{num(3)} {num(4)}", f"{num(3)}/{num(3)}-{num(4)}"))),
        (("phone:", "call", "mobile", "tel."), lambda: r.choice((num(10), "0" + num(10), f"0{num(3)}-{num(7)}"))),
        (("card", "visa", "paid with", "", "credit card", "cc"), lambda: r.choice((spread(card(16), (4, 4, 4, 4), "."), spread(card(16), (4, 4, 4, 4), "  "), spread(card(15), (4, 6, 5), r.choice(" -")), card(15), spread(card(16), (4, 4, 4, 4), " - "), spread(card(14), (4, 6, 4), " "), spread(card(16), (4, 4, 4, 4), "/")))),
        (("ip", "host", "from", "", "server"), lambda: r.choice(("[.]", "(.)", "[dot]", " . ")).join(octet() for _ in range(4))),
        (("mail", "contact", "", "write to", "reach"), lambda: r.choice((f"{word()}.{word()} [at] {word()} [dot] {tld()}", f"{word()}(at){word()}.{tld()}", f"{word()}{num(2)} at {word()} dot {tld()}", f"{word()} @ {word()}.{tld()}", f"{word()}[at]{word()}[dot]{tld()}", f"{word()}é@{word()}.{tld()}", f"{word()} (at) {word()} (dot) {tld()}", f"{word()} (at) {word()} punkt {tld()}", f"{word()}.{word()} at {word()} punto {tld()}", f"{word()}_{word()}{num(1)} [at] {word()}-{word()}.{tld()}"))),
    ]
    false = [
        (("on", "", "date", "between", "since"), lambda: r.choice((f"20{num(2)}-0{r.randint(1, 9)}-1{num(1)} {num(2)}", f"1{num(1)}.0{r.randint(1, 9)}.19{num(2)} {num(2)}", f"19{num(2)}-20{num(2)}", f"1{num(1)}-0{r.randint(1, 9)}-20{num(2)} - 1{num(1)}-1{r.randint(0, 2)}-20{num(2)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/20{num(2)} {num(2)}", f"20{num(2)}/{r.randint(10, 12)}/{r.randint(10, 28)}/{num(3)}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/19{num(2)}-{r.randint(1, 12)}/{r.randint(1, 28)}/20{num(2)}"))),
        (("in", "", "years", "editions", "of"), lambda: r.choice((" ".join(str(r.randint(1900, 2040)) for _ in range(r.randint(3, 5))), "-".join(str(r.randint(1900, 2040)) for _ in range(3)), "/".join(str(r.randint(1900, 2040)) for _ in range(r.randint(2, 4)))))),
        (("at", "", "location", "coordinates", "near"), lambda: r.choice((f"{num(2)}.{num(4)} {num(2)}.{num(4)}", f"{num(2)}.{num(6)} -{num(2)}.{num(6)}", f"{num(1)}.{num(3)} {num(1)}.{num(3)} {num(1)}.{num(3)}"))),
        (("parcel", "", "tracking", "account", "case", "path"), lambda: r.choice((f"{num(12)} {num(4)} {num(4)}", f"{num(4)}0000000{num(1)} 0000 {num(4)}", f"{num(4)}/{num(2)}/{num(8)}", f"{num(2)}/{num(2)} {num(2)}/{num(2)} {num(2)}/{num(2)}", " ".join(f"{k}0" for k in range(1, r.randint(5, 9)))))),
        (("order", "invoice", "item", "serial", "ref", "id", "total"), lambda: r.choice((num(10), num(11), f"{num(4)}-{num(5)}", f"{num(5)} {num(5)}", spread(num(16), (4, 4, 4, 4), "."), num(13), f"{num(3)}-{num(8)}"))),
        (("isbn",), lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}"),
        (("", "sum", "total", "lines", "score"), lambda: r.choice((" ".join(num(2) for _ in range(r.randint(4, 7))), " ".join(num(1) for _ in range(9)), f"{num(1)}.{num(3)}.{num(3)}", f"{num(3)}.{num(3)}.{num(3)}", f"{num(4)} {num(4)}", f"{num(3)}.{num(6)} {num(2)}.{num(6)}", f"{num(1)}.{num(9)}", num(8) + " " + num(8)))),
        (("pi", "ratio", "version", "build", ""), lambda: r.choice((f"3.{num(8)}", f"{num(1)}.{num(2)}.{num(1)}.{num(4)}", f"0.{num(10)}", f"{num(5)}.{num(5)}", f"{num(14)}", f"{num(17)}"))),
        (("token =", "key", "sha", "commit", "", "id", "secret:"), lambda: r.choice((hexed(40), hexed(32), f"{hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(12)}", f"{word()}{num(10)}{word()}", f"ab{num(11)}{hexed(5)}", f"{hexed(6)}c{num(10)}"))),
        (("section", "", "room"), lambda: r.choice((f"{num(3)} . {num(3)}9 . 9{num(2)} . {num(1)}", f"{900 + int(num(2))}[.]{num(2)}[.]{num(1)}[.]{num(1)}"))),
        (("", "look", "was", "stay"), lambda: r.choice((f"{word()} at {word()} . {word().title()}", f"{word()} @ {word()}. {word().title()} {word()}", f"{word()} at {word()}. {word().title()}", f"{word()} at {word()} dot {word()}{word()}{word()}{word()}"))),
    ]
    rows = []
    for k in range(n):
        truth = k % 2
        heads, make = r.choice(true if truth else false)
        head, span = r.choice(heads), make()
        before = " ".join([word() for _ in range(r.randint(0, 4))] + ([head] if head else []))
        before += (" " if before else "") if not before or r.random() < 0.9 else ": "
        rows.append({"text": before + span + r.choice((" ", ". ", ", ", "\n", "")) + word(), "s": len(before), "e": len(before) + len(span), "y": truth})
    return rows


def _scored_rows(spark: SparkSession, rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    table = spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<text:string,s:int,e:int,y:int>>")))
    found = table.withColumn("c", candidates(F.col("text"))).withColumn("c", F.explode(_unique(F.col("c"))))
    truth = ((F.col("y") == 1) & (F.col("c.s") >= F.col("s") - 3) & (F.col("c.e") <= F.col("e") + 1) & ((F.col("c.e") - F.col("c.s")) * 10 >= (F.col("e") - F.col("s")) * 8)).cast("int")
    f = features(F.col("c"))
    got = found.select(truth.alias("truth"), *[f[k].alias(k) for k in FEATURES]).collect()
    a = np.array([list(r) for r in got], dtype=np.int64).reshape(-1, 1 + len(FEATURES))
    return a[:, 1:], a[:, 0]


_MODEL: dict[int, tuple[list, list[float]]] = {}


def model(spark: SparkSession, n: int = LABELLED) -> tuple[list, list[float]]:
    """(trees, threshold of each kind): two thirds of the labelled candidates fit, the rest calibrate."""
    if n not in _MODEL:
        x, y = _scored_rows(spark, labelled_rows(n))
        fit = np.arange(len(x)) % 3 != 2
        trees = boost(x[fit], y[fit].astype(float))
        score = RATE * sum(tree_value(t, x[~fit]) for t in trees)
        _MODEL[n] = trees, [calibrate(score[x[~fit, 0] == k], y[~fit][x[~fit, 0] == k]) for k in range(len(KINDS))]
    return _MODEL[n]


def pii_spans(docs: DataFrame, text_col: str = "text", out: str = "pii", labelled: int = LABELLED) -> DataFrame:
    """Add ``out``: array<struct<kind, s, e, base, score>>, sorted by kind and start. If the input has such
    a column (case aside), underscores come before the new one's name."""
    trees, limits = model(docs.sparkSession, labelled)
    names = docs.columns
    docs, at = numbered(docs, "pii_in_")
    text = F.coalesce(F.col(at(text_col)).cast("string"), F.lit(""))
    raw, more = "pii_raw", "pii_more"

    def scored(c: Column) -> Column:
        f = features(c)
        return F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), F.struct(*[f[k].alias(k) for k in FEATURES]).alias("f"))

    def score(c: Column) -> Column:
        total = F.lit(0.0)
        for t in trees:
            total = total + tree_column(t, c["f"])
        return F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), (total * F.lit(RATE)).alias("score"))

    limit = lambda c: F.element_at(F.array(*[F.lit(v) for v in limits]), c["kind"] + 1)
    kept = F.filter(F.transform(F.transform(_unique(F.col(raw)), scored), score), lambda c: c["score"] >= limit(c))
    rank = lambda c: F.struct(c["score"], c["e"] - c["s"], -c["s"], -c["kind"])
    best = lambda all_: F.filter(all_, lambda c: ~F.exists(all_, lambda d: (d["s"] < c["e"]) & (d["e"] > c["s"]) & (rank(d) > rank(c))))
    own = F.transform(F.filter(F.col(raw), lambda c: c["base"]), lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), F.lit(True).alias("base"), F.lit(None).cast("double").alias("score")))
    added = F.transform(best(F.col(more)), lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), F.lit(False).alias("base"), c["score"].alias("score")))
    return docs.withColumn(raw, candidates(text)).withColumn(more, kept).withColumn("pii_out", F.array_sort(F.concat(own, added))).select(*renamed("pii_in_", names), F.col("pii_out").alias(fresh(out, names)))


def show(spans: Column, where: Callable[[Column], Column]) -> Column:
    """kind:start:end of the spans that fulfil ``where``, comma-joined."""
    name = lambda c: F.element_at(F.array(*map(F.lit, KINDS)), c["kind"] + 1)
    return F.array_join(F.transform(F.filter(spans, where), lambda c: F.concat_ws(":", name(c), c["s"].cast("string"), c["e"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets (of overlapping spans, the first)."""
    name = lambda c: F.element_at(F.array(*map(F.lit, KINDS)), c["kind"] + 1)
    order = F.array_sort(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), name(c).alias("n"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    step = lambda acc, c: F.when(c["s"] < acc["at"], acc).otherwise(F.struct(c["e"].alias("at"), F.concat(acc["done"], F.substring(text, acc["at"] + 1, c["s"] - acc["at"]), F.lit("["), c["n"], F.lit("]")).alias("done")))
    return F.aggregate(order, start, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))
