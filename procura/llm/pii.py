"""Personal data by fixed forms, extended by bootstrapped contexts.

Fixed forms of email, ip, card and phone give the base spans, which always stay. They are
also the seeds of a bootstrap over the whole corpus: the words around a seed (two before;
one before and one after; the label before a separator) are lexical patterns. Candidates
come from the text between base spans, glued to a label or not: what has an @; dotted
numbers of four parts; and numbers of groups held together by blanks, dots, dashes,
slashes, signs and brackets, with the digits a card or phone may have. A number counts as
a whole, and any of its words with enough digits; one of too many digits for a kind counts
as every row of its words that fits. In the graph of
patterns and instances a pattern scores the mean score of its distinct instances, seeds
counting 1, and an unlabelled instance scores the chance that not all its patterns err;
both are updated ROUNDS times as Spark aggregations. A candidate becomes a span of a kind
if a pattern of that kind with at least `support` distinct seeds and a score of at least
`confidence` names it and its own score reaches `confidence`.

One pass over the texts writes base spans and the few candidates with their contexts; all
else runs on those.

Defined cases: null or empty text has no spans; repeated rows come back as often as they
came in and their occurrences count once in the graph; added spans never overlap base
spans; of overlapping added spans the first stays, of those the longest, of those the kind
listed first. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procura.llm.common import written

#: fixed values: kinds in the order of the contract
KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 3
CONFIDENCE = 0.8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_STOP = frozenset(" \t\n\r\v\f\x1c\x1d\x1e\x1f\x85\u00a0:=,;<>()[]{}\"|")
_WORD = re.compile(r"[^\s:=,;<>()\[\]{}\"|]*")
_DOTTED = re.compile(r"(?<![\w@.])[0-9]++(?:\.++[0-9]++)++(?![\w@])")
_SEP = r"[\x20\u00a0./x+\u2010-\u2015-]{0,3}"
_NUMBER = re.compile(rf"(?:(?<![\w@])[x+]{{0,3}}|(?=\())(?:\([0-9]++\)|[0-9]++)(?:{_SEP}(?:\([0-9]++\)|[0-9]++))*x?(?![\w@])")
_PART = re.compile(r"[^\x20\u00a0/]+")
#: kind number, least and most digits of a loose number
_DIGITS = ((2, 12, 19), (3, 7, 15))
_EDGE = "\"'`.,;:!?()[]{}<>"
_BEFORE, _AFTER = 80, 40
_LABEL = re.compile(r"(\w+)\W{1,3}$")
_PLAIN = re.compile(r"[0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small(part: str) -> bool:
    """Whether a part of an address is at most 255, however many zeros it begins with."""
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed forms, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "." in text:
        for m in _IP.finditer(text):
            if all(_small(p) for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a place; digits inside them count alike."""
    before, after = text[max(0, start - _BEFORE) : start], text[end : end + _AFTER]
    words = [_PLAIN.sub("0", w) for w in before.lower().split()[-2:]]
    follow = [_PLAIN.sub("0", w) for w in after.lower().split()[:1]]
    out = []
    if len(words) == 2:
        out.append("before " + " ".join(words))
    if words and follow:
        out.append(f"around {words[-1]} _ {follow[0]}")
    label = _LABEL.search(before)
    if label:
        out.append(f"label {label[0].lower()}")
    return out


def _loose_emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] not in _STOP and not text[start - 1].isspace():
            start -= 1
        done = _WORD.match(text, at).end()
        own = text[start:done].strip(_EDGE)
        if len(own) > 2 and "@" in own:
            start = text.index(own, start)
            yield start, start + len(own)
        at = text.find("@", done)


def _loose_numbers(words: list[tuple[int, int, int]]) -> dict[tuple[int, int], list[int]]:
    """Kinds of each (start, end) that could be a card or phone, from the (start, end, digits) of a number's words."""
    out: dict[tuple[int, int], list[int]] = {}
    total = sum(n for _, _, n in words)
    for kind, least, most in _DIGITS:
        found = set()
        if total <= most:
            if total >= least:
                found.add((words[0][0], words[-1][1]))
            found.update((a, b) for a, b, n in words if n >= least)
        else:
            for i, (a, _, _) in enumerate(words):
                digits = 0
                for _, b, n in words[i:]:
                    digits += n
                    if digits > most:
                        break
                    if digits >= least:
                        found.add((a, b))
        for place in found:
            out.setdefault(place, []).append(kind)
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, list[int]]]:
    """(start, end, kind numbers) of what looks loosely like a kind and touches no base span, sorted."""
    found: dict[tuple[int, int], list[int]] = {}
    taken = [(a, b) for a, _, b in base]
    if "@" in text:
        mails = _outside(list(_loose_emails(text)), sorted(taken))
        found.update((place, [0]) for place in mails)
        taken += mails
    taken.sort()
    if "." in text:
        dotted = [m.span() for m in _DOTTED.finditer(text) if m[0].count(".") == 3]
        for place in _outside(dotted, taken):
            found[place] = [1]
    words, number = [], []
    for m in _NUMBER.finditer(text):
        parts = [(m.start() + p.start(), m.start() + p.end()) for p in _PART.finditer(m[0])]
        words += [(a, b, m.start()) for a, b in parts if any(c.isdigit() for c in text[a:b])]
    free = set(_outside([(a, b) for a, b, _ in words], taken))
    last = None
    for a, b, of in [*words, (0, 0, -1)]:
        here = of if (a, b) in free else None
        if number and here != last:
            for place, kinds in _loose_numbers(number).items():
                found[place] = found.get(place, []) + kinds
            number = []
        if here is not None and of >= 0:
            number.append((a, b, len(_digits(text[a:b]))))
        last = here
    return sorted((a, b, kinds) for (a, b), kinds in found.items())


def _outside(places: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the sorted `places` that overlap none of the sorted spans `taken`."""
    out, k, reach = [], 0, 0
    for a, b in places:
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= a:
            out.append((a, b))
    return out


_SCAN = (
    "row long, doc_id string, base array<struct<start:long,kind:int,end:long>>, "
    "seen array<struct<start:long,end:long,instance:string,kinds:array<int>,seed:boolean,patterns:array<string>>>"
)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        bases, seens = [], []
        for text in batch["text"]:
            text = text or ""
            base = base_spans(text)
            seen = []
            for a, kind, b in base:
                seen.append((a, b, text[a:b], [kind], True, contexts(text, a, b)))
            for a, b, kinds in candidates(text, base):
                seen.append((a, b, text[a:b], kinds, False, contexts(text, a, b)))
            bases.append(base)
            seens.append(seen)
        yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"], "base": bases, "seen": seens})


def _graph(seen: DataFrame, support: int, confidence: float) -> DataFrame:
    """(kind, instance) that confident patterns discovered."""
    edges = written(
        seen.select(F.explode("kinds").alias("kind"), F.col("instance"), F.col("seed"), F.explode("patterns").alias("pattern"))
        .groupBy("kind", "pattern", "instance")
        .agg(F.max("seed").alias("seed"))
    )
    scores = edges.groupBy("kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(ROUNDS):
        patterns = edges.join(scores.select("kind", "instance", "score"), ["kind", "instance"]).groupBy("kind", "pattern").agg(
            F.avg("score").alias("trust"), F.sum(F.col("seed").cast("long")).alias("seeds")
        )
        patterns = written(patterns.where(F.col("seeds") >= support))
        doubt = F.exp(F.sum(F.log1p(-F.least(F.col("trust"), F.lit(0.999)))))
        scores = written(
            edges.join(patterns, ["kind", "pattern"], "left")
            .groupBy("kind", "instance")
            .agg(
                F.when(F.max("seed"), 1.0).otherwise(1 - F.coalesce(doubt, F.lit(1.0))).alias("score"),
                F.max("seed").alias("seed"),
                F.max("trust").alias("trust"),
            )
        )
    return scores.where(~F.col("seed") & (F.col("score") >= confidence) & (F.col("trust") >= confidence)).select("kind", "instance")


def _apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of overlapping spans the first, of those the longest."""
    for batch in batches:
        out = []
        for spans in batch["added"]:
            kept, done = [], 0
            for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= done:
                    kept.append((s["start"], s["kind"], s["end"]))
                    done = s["end"]
            out.append(kept)
        yield pd.DataFrame({"row": batch["row"], "added": out})


def find_pii(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(doc_id, base, added) of every row of `docs` (doc_id, text): arrays of (start, kind number, end)."""
    # ids travel as text: pandas would make floats of a batch of numbers with a null
    doc_id = F.col("doc_id").cast("long").cast("string").alias("doc_id")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), doc_id, "text")
    scanned = written(rows.mapInPandas(_scan, _SCAN).withColumn("doc_id", F.col("doc_id").cast("long")))
    seen = scanned.where("size(seen) > 0").select("row", F.explode("seen").alias("s")).select("row", "s.*")
    new = _graph(seen, support, confidence)
    places = (
        seen.where("not seed")
        .select("row", "start", "end", "instance", F.explode("kinds").alias("kind"))
        .join(new, ["kind", "instance"])
        .groupBy("row", "start", "end")
        .agg(F.min("kind").alias("kind"))
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
        .mapInPandas(_apart, "row long, added array<struct<start:long,kind:int,end:long>>")
    )
    nothing = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    return scanned.join(places, "row", "left").select("doc_id", "base", F.coalesce("added", nothing).alias("added"))


def pii_digest(found: DataFrame) -> DataFrame:
    """The counts of base spans by kind, their digest, and all spans as text."""
    names = F.array(*map(F.lit, KINDS))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind: int) -> Column:
        # of one argument only: a second one would be the place in the array
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [counted(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
