"""Secret scans: fixed patterns, and automata inferred from the credentials that these find.

The base patterns give labelled credentials. A bounded number of them for each kind (``SAMPLE``, those with the smallest
hashes, of up to ``LONGEST`` characters) are turned into strings of character classes and counted in a prefix tree. States
are merged, in breadth-first order and into the most similar one, if they are statistically compatible: the shares of their
next symbols and the distributions of the characters that are still to come agree within Hoeffding bounds, and so do those of
all states below them, as far as bounds can tell anything. So an automaton keeps prefixes and lengths where the credentials
have them, and loops where they have not.

Every token that the automata's alphabets and lengths admit is scored with each automaton by its log-likelihood for each
character against a class-bigram model of ordinary tokens (also from a bounded sample), and is reported when it exceeds the
threshold of its automaton: the least margin of all but a twentieth of held-out credentials (of all, where there are few), but above all but a
small share of ordinary tokens. Base spans stay; added ones have the kind ``grammar`` and never overlap a base span.

Defined results: null and empty texts have no spans; texts are scanned whole, whatever their length; of equally similar
states the first takes a merge; repeated rows give repeated output rows; without any labelled credential nothing is added;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from melisma.llm.common import Out, rows_of, table, texts

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
#: Runs of the characters that credentials consist of; shorter ones than any labelled value are no candidates.
TOKEN = r"[A-Za-z0-9+/_=.-]"
SAMPLE, LONGEST, ALPHA, FEWEST, ORDINARY_SHARE = 1500, 256, 0.05, 12, 0.005
_START, _END, _TRIM = "^", "$", ".-=/+_"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """start, kind's number, end, secret; leftmost and non-overlapping within each kind, in order."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def classes(token: str) -> str:
    """Character classes: digits, a-f, other lower case, A-F, other upper case; each sign is its own class."""
    return token.translate(_CLASS)


_CLASS = str.maketrans({**{c: "d" for c in "0123456789"}, **{c: "h" for c in "abcdef"}, **{c: "l" for c in "ghijklmnopqrstuvwxyz"}, **{c: "H" for c in "ABCDEF"}, **{c: "U" for c in "GHIJKLMNOPQRSTUVWXYZ"}})


class Automaton:
    """A probabilistic automaton: for every state its next states and the log shares of its symbols."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        nxt: list[dict[str, int]] = [{}]
        out: list[Counter] = [Counter()]
        left: list[Counter] = [Counter()]  # characters still to come
        depth = [0]
        for s in strings:
            q = 0
            for i, c in enumerate(s):
                out[q][c] += 1
                left[q][len(s) - i] += 1
                if c not in nxt[q]:
                    nxt[q][c] = len(nxt)
                    nxt.append({})
                    out.append(Counter())
                    left.append(Counter())
                    depth.append(i + 1)
                q = nxt[q][c]
            out[q][_END] += 1
            left[q][0] += 1
        bound = math.sqrt(0.5 * math.log(2 / alpha))

        def apart(a: Counter, b: Counter) -> float:
            """The greatest difference of two cumulative distributions."""
            na, nb, x, y, most = a.total(), b.total(), 0, 0, 0.0
            for k in sorted(a.keys() | b.keys()):
                x, y = x + a[k], y + b[k]
                most = max(most, abs(x / na - y / nb))
            return most

        def compatible(a: int, b: int) -> float | None:
            """How far the states are apart, null if they or any states below them are too far."""
            own, todo = apart(left[a], left[b]), [(a, b)]
            done = set()
            while todo:
                pair = a, b = todo.pop()
                if pair in done or a == b:
                    continue
                done.add(pair)
                na, nb = out[a].total(), out[b].total()
                reach = bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
                if reach >= 1:  # no difference could be told, here or below
                    continue
                if apart(left[a], left[b]) > reach or any(abs(out[a][c] / na - out[b][c] / nb) > reach for c in out[a].keys() | out[b].keys()):
                    return None
                todo += [(nxt[a][c], nxt[b][c]) for c in nxt[a].keys() & nxt[b].keys()]
            return own

        def fold(a: int, b: int) -> None:
            todo = [(a, b)]
            while todo:
                a, b = todo.pop()
                if a == b:
                    continue
                out[a].update(out[b])
                left[a].update(left[b])
                for c, t in nxt[b].items():
                    if c in nxt[a]:
                        todo.append((nxt[a][c], t))
                    else:
                        nxt[a][c] = t

        red, kept = [0], {0}
        while True:
            blue = [(depth[nxt[q][c]], -out[nxt[q][c]].total(), q, c) for q in red for c in nxt[q] if nxt[q][c] not in kept]
            if not blue:
                break
            *_, p, c = min(blue)
            t = nxt[p][c]
            near = [(d, i) for i, r in enumerate(red) if (d := compatible(r, t)) is not None]
            if near:
                r = red[min(near)[1]]
                nxt[p][c] = r
                fold(r, t)
            else:
                red.append(t)
                kept.add(t)
        number = {q: i for i, q in enumerate(red)}
        self.next = [{c: number[t] for c, t in nxt[q].items() if t in number} for q in red]
        symbols = len({c for q in red for c in out[q]}) + 1
        self.log = [{c: math.log((n + 0.1) / (out[q].total() + 0.1 * symbols)) for c, n in out[q].items()} for q in red]
        self.unseen = [math.log(0.1 / (out[q].total() + 0.1 * symbols)) for q in red]
        #: Where most strings go on from a state; a symbol never seen there goes the same way.
        self.usual = [max(((out[q][c], -number[t]) for c, t in nxt[q].items() if t in number), default=(0, 1))[1] for q in red]

    def score(self, s: str) -> float:
        """Log-likelihood of the classes and the end; -inf where no string goes on."""
        q, total = 0, 0.0
        for c in s:
            if self.usual[q] > 0:
                return -math.inf
            total += self.log[q].get(c, self.unseen[q])
            q = self.next[q].get(c, -self.usual[q])
        return total + self.log[q].get(_END, self.unseen[q])


class Ordinary:
    """A class-bigram model of ordinary tokens."""

    def __init__(self, tokens: list[str]):
        pairs: dict[str, Counter] = defaultdict(Counter)
        for t in tokens:
            for a, b in zip(_START + t, t + _END, strict=True):
                pairs[a][b] += 1
        self.log = {a: {b: math.log((n + 0.5) / (c.total() + 10)) for b, n in c.items()} for a, c in pairs.items()}
        self.unseen = {a: math.log(0.5 / (c.total() + 10)) for a, c in pairs.items()}

    def score(self, s: str) -> float:
        return sum(self.log.get(a, {}).get(b, self.unseen.get(a, -3.0)) for a, b in zip(_START + s, s + _END, strict=True))


class Grammar:
    """Automata of the kinds with their thresholds."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str]):
        self.plain = Ordinary([classes(t) for t in ordinary])
        self.models: list[tuple[Automaton, float, frozenset[str], range]] = []
        self.known: dict[str, bool] = {}
        other_classes = [classes(t) for t in ordinary]
        for kind in sorted(labelled):
            strings = [classes(t.rstrip(".")) for t in labelled[kind]]
            strings = [s for s in strings if s]
            if not strings:
                continue
            few = len(strings) < FEWEST
            model = Automaton(strings if few else [s for i, s in enumerate(strings) if i % 4])
            own = sorted(self._margin(model, s) for s in (strings if few else strings[::4]))
            lengths = range(min(map(len, strings)), max(map(len, strings)) + 1)
            other = sorted(self._margin(model, s) for s in other_classes if len(s) in lengths)
            low, high = own[len(own) // 20], other[-1 - int(len(other) * ORDINARY_SHARE)] if other else -math.inf
            if low > -math.inf:
                self.models.append((model, max(low, math.nextafter(max(high, 0.2), math.inf)), frozenset("".join(strings)), lengths))
        shortest = min((m[-1].start for m in self.models), default=None)
        #: Finds the candidates; null if there is no model.
        self.candidate = shortest and re.compile(f"{TOKEN}{{{shortest},}}")
        self.longest = max((m[-1].stop for m in self.models), default=0)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}}

    def _margin(self, model: Automaton, s: str) -> float:
        return (model.score(s) - self.plain.score(s)) / (len(s) + 1)

    def accepts(self, token: str) -> bool:
        s = classes(token)
        if s not in self.known:
            if len(self.known) >= 1 << 16:
                self.known.clear()
            self.known[s] = any(len(s) in lengths and alphabet.issuperset(s) and self._margin(m, s) >= least for m, least, alphabet, lengths in self.models)
        return self.known[s]

    def found(self, text: str) -> Iterator[tuple[int, int]]:
        """Start and end of the tokens that are accepted, as they stand or without signs at their ends."""
        for m in self.candidate.finditer(text) if self.candidate else ():
            if len(m[0]) >= self.longest + 16:
                continue
            bare = m[0].strip(_TRIM)
            for token in dict.fromkeys((m[0], m[0].rstrip("."), bare)):
                if token and self.accepts(token):
                    start = m.start() + m[0].find(token)
                    yield start, start + len(token)
                    break


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct credentials with the smallest hashes of each partition and kind, and so for ordinary tokens."""
    best: dict[str, dict[int, str]] = defaultdict(dict)

    def offer(kind: str, token: str) -> None:
        kept = best[kind]
        kept[xxhash.xxh64_intdigest(token)] = token
        if len(kept) > 4 * SAMPLE:
            best[kind] = {h: kept[h] for h in sorted(kept)[:SAMPLE]}

    for (text,) in rows_of(batches, "text"):
        found = base_spans(text)
        for _, k, _, secret in found:
            if len(secret) <= LONGEST:
                offer(KINDS[k], secret)
        secret = {s for *_, s in found}
        for t in text.split()[:: 97]:
            if t not in secret and t.isascii() and len(t) <= LONGEST:
                offer("plain", t)
    out = Out(pa.schema([("kind", pa.string()), ("h", pa.int64()), ("token", pa.string())]))
    for kind, kept in best.items():
        for h in sorted(kept)[:SAMPLE]:
            out.add(kind, h - (1 << 63), kept[h])
    yield out.take()


def learn(docs: DataFrame) -> Grammar:
    """Reads all texts; at most ``SAMPLE`` distinct strings of each kind come to the driver."""
    least = texts(docs).select("text").mapInArrow(_labelled, "kind string, h long, token string").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    # the smallest of some partitions each, then of all, so that no task gets the strings of every partition
    for keys in (["kind", "part"], ["kind"]):
        least = least.dropDuplicates([*keys, "h"]).withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("r") <= SAMPLE)
    ranked = least
    labelled: dict[str, list[str]] = defaultdict(list)
    for kind, token in ranked.select("kind", "token").orderBy("kind", "r").collect():
        labelled[kind].append(token)
    return Grammar({k: v for k, v in labelled.items() if k != "plain"}, labelled.get("plain", []))


def all_spans(text: str, grammar: Grammar) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans (start, end, kind) in order."""
    base = base_spans(text)
    spans = [(a, KINDS[k], b) for a, k, b, _ in base]
    covered, more = sorted((a, b) for a, _, b in spans), []
    at = 0
    for start, end in grammar.found(text):
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        clash, i = False, at
        while not clash and i < len(covered) and covered[i][0] < end:
            clash = covered[i][1] > start
            i += 1
        if not clash:
            more.append((start, "grammar", end))
    order = {k: i for i, k in enumerate((*KINDS, "grammar"))}
    both = sorted([*spans, *more], key=lambda x: (x[0], order[x[1]], x[2]))
    return base, [(a, b, k) for a, k, b in both]


def scan(docs: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """doc_id, text, base and spans (arrays of kind, start, end in code points) of every row that has an id."""
    grammar = grammar or learn(docs)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(grammar)  # its size is bounded by SAMPLE
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(pa.schema([("doc_id", pa.int64()), ("base", span), ("spans", span)]))
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            base, every = all_spans(text, shared.value)
            out.add(doc_id, [{"kind": KINDS[k], "start": a, "end": b} for a, k, b, _ in base], [{"kind": k, "start": a, "end": b} for a, b, k in every])
            if out.full():
                yield out.take()
        yield out.take()

    kind = "array<struct<kind:string,start:long,end:long>>"
    return texts(docs).mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def masked(text: str, grammar: Grammar) -> str:
    """The text with every span replaced by a marker of its kind."""
    spans, parts, at = all_spans(text, grammar)[1], [], 0
    for a, b, kind in spans:
        if b > at:
            parts += [text[at : max(a, at)], f"[{kind}]"]
            at = b
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """The rows with all their columns, secrets in ``text`` replaced by markers; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar or learn(docs))

    @F.pandas_udf("string")
    def hide(t):
        return t.map(lambda x: None if x is None else masked(x, shared.value))

    return docs.withColumn("text", hide("text"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))

    def line(column):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def number(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [number(k) for k in KINDS]
    return found.select("doc_id", *count, F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))
