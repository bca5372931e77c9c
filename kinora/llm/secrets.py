"""Secret scans: fixed patterns, and formats learned from them by grammar inference.

The base patterns find assigned values, access keys and long hexadecimal runs.  Of the credentials they
find in all texts a bounded sample serves as labelled strings: for each kind a prefix tree is built over character classes and its statistically
compatible states are merged (ALERGIA, Carrasco and Oncina 1994) into a probabilistic automaton.  More automata are
inferred from ordinary tokens, one for each shape: whether there are letters, digits and other characters.  Every token
of every text, a run of LEAST or more of the characters that an assigned value may have, without what base spans cover of
it and without dots at its ends, is then scored by how much likelier the best credential format is than an ordinary token
of its shape; those are added as spans that are MARGIN times as likely or more.  Tokens that a format's automaton accepts
and makes as much likelier than characters drawn evenly are not learned from as ordinary ones, since a corpus with many
bare credentials would else teach their format as that of ordinary text.

Defined results: null and empty texts have no spans; rows are scanned one by one, so repeated rows and ids change
nothing; with no labelled credential in the sample nothing is added.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinora.llm.batches import record, text_slices
from kinora.session import discard, stored

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters that the shortest token has, as the shortest assigned value.
LEAST = 6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{%d,}[A-Za-z0-9+/_=-]" % (LEAST - 2))
#: In the order of ties.
KINDS = ("assign", "access", "hex", "grammar")
#: Distinct labelled strings per kind, and ordinary tokens per shape, that are learned from; taken whole, in the order of
#: a hash.
SAMPLE_STRINGS = 400
#: Once those of a kind hold so many characters together, no more are taken; the one that reaches it is whole as well.
SAMPLE_CHARS = 200_000
#: Judged tokens that a task remembers.
KNOWN = 1 << 17
#: Natural logarithm of how much likelier the credential format has to be.
MARGIN = math.log(1000)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns. HEX starts at 24 since a run of hexadecimal digits is found whole or not at all."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return ordered(found)


def ordered(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def credential(text: str, span: Span) -> str:
    """The secret itself, without the name it is assigned to."""
    kind, start, end = span
    return ASSIGN.match(text, start).group(2) if kind == "assign" else text[start:end]


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Tokens, and of those that base spans cover in part what is left of them."""
    found = [m.span() for m in CANDIDATE.finditer(text)]
    if not base or not found:
        return found
    starts, ends, reach = [s for _, s, _ in base], [], 0
    for _, _, e in base:  # base spans are ordered by start, so the furthest end so far is all that matters
        ends.append(reach := max(reach, e))
    out = []
    for a, b in found:
        k = bisect_right(ends, a)  # the first span that ends beyond the token's start
        while a < b:
            stop = min(b, starts[k]) if k < len(starts) else b
            out += [m.span() for m in CANDIDATE.finditer(text, a, stop)] if stop - a >= LEAST else []
            if k == len(starts):
                break
            a, k = max(a, ends[k]), k + 1
    return out


_CLASSES = str.maketrans({**dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("ABCDEF", "H"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "U"), **dict.fromkeys("0123456789", "d")})
#: How many characters are in a class: a format gives its classes, any character of a class is as likely.
_SIZES = {"h": 6, "l": 20, "H": 6, "U": 20, "d": 10}


def _log_size(c: str) -> float:
    return math.log(_SIZES.get(c, 1))


def classes(text: str) -> str:
    return text.translate(_CLASSES)


#: Kinds of ordinary tokens by their letters, digits and other characters.
SHAPES = ("l", "d", "ld", "o", "lo", "do", "ldo")
_LETTER, _LOWER, _UPPER, _DIGIT, _OTHER = map(re.compile, ("[A-Za-z]", "[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))


def shape(token: str) -> str:
    if token.isalpha():
        return "l"
    return "l" * bool(_LETTER.search(token)) + "d" * bool(_DIGIT.search(token)) + "o" * bool(_OTHER.search(token))


class Smallest:
    """The distinct strings first in the order of a hash: ``count`` of them, or fewer that reach ``chars`` characters."""

    def __init__(self, count: int = SAMPLE_STRINGS, chars: int = SAMPLE_CHARS):
        self.count, self.chars, self.size, self.last = count, chars, 0, None
        self.kept: dict[bytes, str] = {}

    def add(self, string: str) -> None:
        h = hashlib.blake2b(string.encode(), digest_size=16).digest()
        if h in self.kept or (self.last is not None and h > self.last):
            return
        self.kept[h] = string
        self.size += len(string)
        if len(self.kept) > 2 * self.count or self.size > 2 * self.chars:
            self.items()

    def items(self) -> list[tuple[bytes, str]]:
        """(hash, string) in order; what comes after them is dropped."""
        found, size = [], 0
        for item in sorted(self.kept.items()):
            if len(found) == self.count or size >= self.chars:
                self.last = found[-1][0]
                break
            found.append(item)
            size += len(item[1])
        self.kept, self.size = dict(found), size
        return found


class Automaton:
    """A deterministic probabilistic automaton: per state its visits, ends, and transitions with their counts."""

    def __init__(self):
        self.visits, self.ends, self.next, self.steps = [0], [0], [{}], [{}]

    @classmethod
    def infer(cls, strings: list[str], confidence: float = 0.05) -> Automaton:
        """Build the prefix tree of ``strings``, then fold compatible states together, nearest to the root first."""
        tree = cls()
        for s in strings:
            at = 0
            tree.visits[0] += 1
            for c in s:
                to, n = tree.next[at].get(c, (None, 0))
                if to is None:
                    to = len(tree.visits)
                    tree.visits.append(0)
                    tree.ends.append(0)
                    tree.next.append({})
                tree.next[at][c] = (to, n + 1)
                at = to
                tree.visits[at] += 1
            tree.ends[at] += 1
        tree._bound = math.sqrt(0.5 * math.log(2 / confidence))
        settled, seen = [0], {0}
        while blue := [(to, at, c) for at in settled for c, (to, _) in tree.next[at].items() if to not in seen]:
            to, at, c = min(blue)
            for state in settled:
                if tree._compatible(state, to):
                    tree.next[at][c] = (state, tree.next[at][c][1])
                    tree._fold(state, to)
                    break
            else:
                settled.append(to)
                seen.add(to)
        return tree._only(settled)

    def _only(self, states: list[int]) -> Automaton:
        """The automaton of ``states`` alone, the first of them its start, with the logarithms that a walk adds up."""
        new, out = {s: k for k, s in enumerate(states)}, Automaton()
        out.visits, out.ends = [self.visits[s] for s in states], [self.ends[s] for s in states]
        out.next = [{c: (new[to], n) for c, (to, n) in self.next[s].items()} for s in states]
        out.steps = [{c: (to, math.log((n + 0.01) / (v + 0.1)) - _log_size(c)) for c, (to, n) in t.items()} for t, v in zip(out.next, out.visits)]
        return out

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        """Hoeffding's bound on two observed shares."""
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self._bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.ends[a], self.visits[a], self.ends[b], self.visits[b]):
                return False
            for c in {*self.next[a], *self.next[b]}:
                (x, n), (y, m) = self.next[a].get(c, (None, 0)), self.next[b].get(c, (None, 0))
                if self._differ(n, self.visits[a], m, self.visits[b]):
                    return False
                if x is not None and y is not None:
                    todo.append((x, y))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to the automaton at ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, (y, m) in self.next[b].items():
                x, n = self.next[a].get(c, (None, 0))
                self.next[a][c] = (y if x is None else x, n + m)
                if x is not None:
                    todo.append((x, y))

    def accepts(self, text: str) -> bool:
        """Whether every step and the end were seen."""
        at = 0
        for c in classes(text):
            if (step := self.steps[at].get(c)) is None:
                return False
            at = step[0]
        return self.ends[at] > 0

    def log_likelihood(self, text: str) -> float:
        """Of the characters and of ending after them; what was never seen has half a count."""
        at, total = 0, 0.0
        string = classes(text)
        for k, c in enumerate(string):
            if (step := self.steps[at].get(c)) is None:  # left for good: what follows, and the end, is as unseen as can be
                rest = string[k + 1 :]
                sizes = sum(rest.count(x) * _log_size(x) for x in _SIZES)
                return total + math.log(0.01 / (self.visits[at] + 0.1)) - _log_size(c) + (len(rest) + 1) * math.log(0.1) - sizes
            at, p = step
            total += p
        return total + math.log((self.ends[at] + 0.01) / (self.visits[at] + 0.1))


def even(token: str) -> float:
    """Logarithm of the likelihood of the token's characters if those of its kinds are drawn evenly."""
    cases = 26 * (bool(_LOWER.search(token)) + bool(_UPPER.search(token)))
    return -len(token) * math.log(cases + 10 * bool(_DIGIT.search(token)) + 6 * bool(_OTHER.search(token)))


class Formats:
    """Automata for the credential kinds and for ordinary tokens by their shape."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: Iterable[str]):
        self.kinds = {k: Automaton.infer([classes(s) for s in v]) for k, v in sorted(labelled.items()) if v}
        by: dict[str, list[str]] = {}
        for token in ordinary:
            if not any(a.accepts(token) and a.log_likelihood(token) - even(token) >= MARGIN for a in self.kinds.values()):
                by.setdefault(shape(token), []).append(classes(token))
        self.ordinary = {k: Automaton.infer(v) for k, v in sorted(by.items())}
        self._judged: dict[str, bool] = {}

    def best(self, token: str) -> float:
        return max(a.log_likelihood(token) for a in self.kinds.values())

    def score(self, token: str) -> float:
        """Logarithm of how much likelier the best credential format makes the token than its shape does."""
        if not self.kinds:
            return -math.inf
        known = self.ordinary.get(shape(token))
        return self.best(token) - (known.log_likelihood(token) if known else even(token))

    def added(self, text: str, base: list[Span]) -> list[Span]:
        if not self.kinds or not base and not any(map(self.likely, set(CANDIDATE.findall(text)))):
            return []
        return [("grammar", a, b) for a, b in candidates(text, base) if self.likely(text[a:b])]

    def likely(self, token: str) -> bool:
        """Whether the token is a credential; what was found of short ones is kept for a while, as most are words."""
        got = self._judged.get(token)
        if got is None:
            got = self.score(token) >= MARGIN
            if len(token) <= 64:
                if len(self._judged) >= KNOWN:
                    self._judged.clear()
                self._judged[token] = got
        return got

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_judged": {}}


LEARNED = (*KINDS[:3], *SHAPES)


def labelled_strings(docs: DataFrame, strings: int = SAMPLE_STRINGS) -> DataFrame:
    """(kind, hash, string) as found by the base patterns and, with their shape as kind, tokens they leave, in all texts.

    A task keeps those of each kind that come first by their hash, so the first of all are among them.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, seen = {k: Smallest(strings) for k in LEARNED}, set()
        for batch in (part for whole in batches for part in text_slices(whole)):
            tokens = set()
            for text in batch.column("text").to_pylist():
                if text:
                    base = base_spans(text)
                    for s in base:
                        kept[s[0]].add(credential(text, s))
                    tokens.update([text[a:b] for a, b in candidates(text, base)] if base else CANDIDATE.findall(text))
            for token in tokens - seen:
                kept[shape(token)].add(token)
            seen = seen | tokens if len(seen) < KNOWN else set()
        for kind, some in kept.items():
            if items := some.items():
                hashes, found = zip(*items)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(items), pa.string()), pa.array(hashes, pa.binary()), pa.array(found, pa.string())], names=["kind", "hash", "string"])

    return texts.mapInArrow(run, "kind string, hash binary, string string").distinct()


def learn(docs: DataFrame, strings: int = SAMPLE_STRINGS) -> Formats:
    """Formats inferred on the driver from at most ``strings`` strings of each kind and shape."""
    found = stored(labelled_strings(docs, strings), "credentials")
    parts = [found.where(F.col("kind") == k).orderBy("hash").limit(strings) for k in LEARNED]
    kept = {k: Smallest(strings) for k in LEARNED}
    for row in reduce(DataFrame.union, parts).collect():
        kept[row.kind].add(row.string)
    discard(found)
    learned = {k: sorted(s for _, s in v.items()) for k, v in kept.items()}
    return Formats({k: learned[k] for k in KINDS[:3]}, (s for k in SHAPES for s in learned[k]))


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """Per row of ``docs``: doc_id, counts of the base kinds, base_sha256, spans, n_grammar."""
    bound = docs.sparkSession.sparkContext.broadcast(formats)
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_grammar", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole)):
            texts = batch.column("text").to_pylist()
            base = [base_spans(t) if t else [] for t in texts]
            extra = [bound.value.added(t, b) if t else [] for t, b in zip(texts, base)]
            counts = [[sum(s[0] == k for s in b) for b in base] for k in KINDS[:3]]
            yield record(schema, batch.column("doc_id"), *counts, [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], [joined(ordered(b + e)) for b, e in zip(base, extra)], [len(e) for e in extra])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_grammar long")


def redacted(text: str | None, formats: Formats, mark: str = "[REDACTED]") -> str | None:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for _, a, b in ordered(base + formats.added(text, base)):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, formats: Formats, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with the same columns, secrets in ``text`` replaced."""
    bound = docs.sparkSession.sparkContext.broadcast(formats)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole)):
            k = batch.schema.get_field_index("text")
            texts = [redacted(t, bound.value, mark) for t in batch.column(k).to_pylist()]
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return docs.mapInArrow(run, schema)
