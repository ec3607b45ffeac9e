"""Secret scans: fixed patterns, and formats learnt by grammar inference.

Base spans are what the patterns of BASE find. Their values are labelled
credentials. All distinct values, and half of all distinct other tokens, are turned into
prefix trees over classes of characters, one for each kind and one for ordinary
tokens; the trees are counted on Spark. States of a tree whose continuations don't differ statistically (Hoeffding
bounds, from the root outwards) are merged, which leaves small probabilistic
automata. Merging takes the `most_nodes` commonest prefixes of a tree at most and all that follow one of them, with
their counts over all strings; then every string is run through the automaton, whole, and its steps make the
probabilities. What base spans leave of every token of a text is then scored whole, if it has
LEAST_LEARNT characters: where a kind's automaton makes it likelier than the ordinary one by
enough nats, it is a span of kind "learnt". Were the ordinary automaton the truth, a gain of g nats
would come by chance with a probability of exp(-g) at most, so ln(1 / false_rate) is enough; by how much
the other half of the ordinary tokens, held out from the fit, exceeds that rule at a share of `tail` (where
a few unlabelled credentials among them don't count) is added. Base spans always stay.

All spans are offsets in code points, the end exclusive. The driver gets prefixes within their bound, sums by
state and sums by gain; the automata are broadcast. Two scans of the whole texts, one shuffle of the
distinct tokens.

Null and empty texts have no spans; null ids stay null; with too few labelled
credentials of a kind it learns no format. Repeated rows are scanned each; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialize, slices

# The kinds, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
STEMS = ("passw", "secret", "token", "api")

LEARNT = "learnt"
LEAST_LEARNT = 6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_LEARNT)
#: Up to so many strings, each is scored alone: steps over a few array elements cost more than a loop.
FEW = 6
LONG_HEX = re.compile(r"[0-9a-f]{%d}" % LEAST_HEX)
#: Classes of characters: a-f, g-z, A-F, G-Z, digits, the other signs one by one.
CLASSES = np.full(128, 9, np.int64)
for _k, _chars in enumerate(("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/", "_", ".", "=", "-")):
    CLASSES[[ord(c) for c in _chars]] = _k
N_CLASSES, END = 10, 10


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base spans, in order."""
    out = []
    lower = text.lower()
    if any(s in lower for s in STEMS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if LONG_HEX.search(text):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]
    return sorted(out)


def free_tokens(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the parts of candidate tokens outside the spans (in order of their starts) that are long enough."""
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while k < len(spans) and spans[k][2] <= at:
            k += 1
        for s, _, e in spans[k:]:
            if s >= end:
                break
            if s - at >= LEAST_LEARNT:
                out.append((at, s))
            at = max(at, e)
        if end - at >= LEAST_LEARNT:
            out.append((at, end))
    return out


@dataclass
class Automaton:
    """Deterministic, probabilistic: next state and log probability by state and class; class END ends the string."""

    following: np.ndarray
    log_p: np.ndarray

    def likelihoods(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-likelihood of each string; all strings take a step at a time, the last few, longest ones one after another."""
        total, state, todo, step = np.zeros(len(starts)), np.zeros(len(starts), np.int64), np.arange(len(starts)), 0
        while len(todo) > FEW:
            ended = lengths[todo] == step
            done = todo[ended]
            total[done] += self.log_p[state[done], END]
            todo = todo[~ended]
            c = codes[starts[todo] + step]
            total[todo] += self.log_p[state[todo], c]
            state[todo] = self.following[state[todo], c]
            step += 1
        following, log_p = self.following.tolist(), self.log_p.tolist()
        for i in todo.tolist():
            own, now = float(total[i]), int(state[i])
            for c in codes[starts[i] + step : starts[i] + lengths[i]].tolist():
                own += log_p[now][c]
                now = following[now][c]
            total[i] = own + log_p[now][END]
        return total


def infer(strings: list[str], alpha: float = 0.5, smoothing: float = 0.2) -> Automaton:
    """Merges compatible states of the strings' prefix tree, from the root outwards; the larger alpha, the sooner two states differ."""
    children: list[dict[int, int]] = [{}]
    counts: list[np.ndarray] = [np.zeros(N_CLASSES + 1)]
    for s in strings:
        node = 0
        for c in encode([s])[0].tolist():
            counts[node][c] += 1
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                counts.append(np.zeros(N_CLASSES + 1))
            node = children[node][c]
        counts[node][END] += 1
    following, counts = merged(children, np.array(counts), alpha)
    return automaton(following, counts, smoothing)


def merged(children: list[dict[int, int]], counts: np.ndarray, alpha: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Next state and counts by state and class of a prefix tree (node 0: the root) after merging; the last state is that of unknown steps."""
    margin = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = counts[a].sum(), counts[b].sum()
            if n and m and (np.abs(counts[a] / n - counts[b] / m) > margin * (n**-0.5 + m**-0.5)).any():
                return True
            todo += [(children[a][c], x) for c, x in children[b].items() if c in children[a]]
        return False

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            counts[a] += counts[b]
            for c, x in children[b].items():
                if c in children[a]:
                    todo.append((children[a][c], x))
                else:
                    children[a][c] = x

    def near(final: list[int], node: int) -> list[int]:
        """The states whose own continuations don't differ from the node's, all compared at once."""
        own, m = counts[final], counts[node].sum()
        n = own.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            apart = (np.abs(own / n - counts[node] / m) > margin * (n**-0.5 + m**-0.5)).any(axis=1)
        return [final[i] for i in np.flatnonzero(~apart)]

    final, queue = [0], [(0, c) for c in sorted(children[0])]
    is_final = {0}
    while queue:
        parent, c = queue.pop(0)
        node = children[parent][c]
        if node in is_final:
            continue
        # A tree below a state that is merged hangs on no other state, so folding it can't loop.
        for state in near(final, node):
            if not differ(state, node):
                children[parent][c] = state
                known = set(children[state])
                fold(state, node)
                queue += [(state, x) for x in sorted(set(children[state]) - known)]
                break
        else:
            final.append(node)
            is_final.add(node)
            queue += [(node, x) for x in sorted(children[node])]
        # Folding may have given final states new children that aren't final yet.
        if not queue:
            queue = [(s, x) for s in final for x, t in sorted(children[s].items()) if t not in is_final]
    number = {s: i for i, s in enumerate(final)}
    following = np.full((len(final) + 1, N_CLASSES), len(final), np.int64)
    for s, i in number.items():
        for c, t in children[s].items():
            following[i, c] = number[t]
    return following, np.concatenate([counts[final], np.zeros((1, N_CLASSES + 1))])


def automaton(following: np.ndarray, counts: np.ndarray, smoothing: float = 0.2) -> Automaton:
    weights = counts + smoothing
    return Automaton(following, np.log(weights / weights.sum(axis=1, keepdims=True)))


def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all characters in one array, starts and lengths. Characters beyond ASCII don't occur in candidates."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    codes = CLASSES[np.minimum(np.frombuffer("".join(strings).encode("ascii", "replace"), np.uint8), 127)]
    return codes, np.cumsum(lengths) - lengths, lengths


def decode(written: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As encode, of strings of classes as digits."""
    lengths = np.fromiter(map(len, written), np.int64, len(written))
    return np.frombuffer("".join(written).encode(), np.uint8).astype(np.int64) - ord("0"), np.cumsum(lengths) - lengths, lengths


def visits(following: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often strings, each as often as `times`, take each step from each state."""
    out, state, todo, step = np.zeros((len(following), N_CLASSES + 1)), np.zeros(len(starts), np.int64), np.arange(len(starts)), 0
    while len(todo) > FEW:
        ended = lengths[todo] == step
        np.add.at(out, (state[todo[ended]], END), times[todo[ended]])
        todo = todo[~ended]
        c = codes[starts[todo] + step]
        np.add.at(out, (state[todo], c), times[todo])
        state[todo] = following[state[todo], c]
        step += 1
    rows = following.tolist()
    for i in todo.tolist():
        now, n = int(state[i]), times[i]
        for c in codes[starts[i] + step : starts[i] + lengths[i]].tolist():
            out[now, c] += n
            now = rows[now][c]
        out[now, END] += n
    return out


@dataclass
class Formats:
    credentials: list[Automaton]
    ordinary: Automaton | None
    least_gain: float

    def gains(self, strings: list[str]) -> np.ndarray:
        """How many nats likelier than as an ordinary token each string is as a credential of the best kind."""
        return self.gains_of(*encode(strings))

    def gains_of(self, *coded: np.ndarray) -> np.ndarray:
        best = np.max([a.likelihoods(*coded) for a in self.credentials], axis=0)
        return best - self.ordinary.likelihoods(*coded)

    def learnt(self, strings: list[str]) -> np.ndarray:
        """Which of the strings look like credentials."""
        if not self.credentials or self.ordinary is None or not strings:
            return np.zeros(len(strings), bool)
        return self.gains(strings) >= self.least_gain


class Judge:
    """Formats in a Python worker: strings met before aren't scored again, within a bound."""

    def __init__(self, formats: Formats, most: int = 300_000):
        self.formats, self.most, self.seen = formats, most, {}

    def learnt(self, strings: list[str]) -> list[bool]:
        new = list({s for s in strings if s not in self.seen})
        fresh = dict(zip(new, self.formats.learnt(new).tolist(), strict=True))
        if len(self.seen) + len(new) > self.most:
            fresh |= {s: self.seen[s] for s in strings if s in self.seen}
            self.seen = {}
        self.seen.update(fresh)
        out = [self.seen[s] for s in strings]
        for s in new:
            if len(s) > 64:
                self.seen.pop(s, None)
        return out


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fitted(values: list[list[str]], ordinary: list[str], least_rows: int = 8, false_rate: float = 1e-6, tail: float = 0.02, fit_rows: int = 2_000) -> Formats:
    """Automata of each kind's values and of the first `fit_rows` ordinary tokens, at most half of them; the others correct the least gain."""
    n = min(fit_rows, (len(ordinary) + 1) // 2)
    found = Formats([infer(v) for v in values if len(v) >= least_rows], infer(ordinary[:n]) if n else None, math.log(1 / false_rate))
    held_out = ordinary[n:]
    if found.credentials and held_out:
        gains = np.sort(found.gains(held_out))[::-1]
        found.least_gain += max(0.0, float(gains[int(tail * len(gains))]) - math.log(1 / tail))
    return found


#: Digits of the classes of a string's characters.
DIGITS = bytes(ord("0") + int(CLASSES[min(i, 127)]) for i in range(256))
#: Steps of a nat that gains are counted by.
STEPS = 64


def all_strings(docs: DataFrame, most_seen: int = 100_000) -> DataFrame:
    """kind, aside (held out from the fit), code (classes as digits), n of all distinct labelled values, and of all distinct ordinary tokens as the last kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in slices(batches, "text"):
            rows = set()
            for t in b.column("text").to_pylist():
                spans = base_spans(t or "")
                rows.update((kind, ASSIGN.match(t, s)[2] if kind == 0 else t[s:e]) for s, kind, e in spans)
                rows.update((len(KINDS), t[s:e]) for s, e in free_tokens(t or "", spans))
            rows -= seen
            if len(seen) > most_seen:
                seen = set()
            seen.update(r for r in rows if len(r[1]) <= 64)
            if rows:
                kinds, values = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values)], ["kind", "value"])

    found = arrow_map(id_and_text(docs), run, "kind int, value string")
    # Distinct values, so that copies don't weigh more. What stands as a credential somewhere is no ordinary token.
    found = found.groupBy("value").agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("kinds"))
    of = F.filter(F.array(*(F.lit(k) for k in range(len(KINDS) + 1))), lambda k: F.when(k == len(KINDS), F.col("kinds") == 1 << len(KINDS)).otherwise(F.expr("kinds").bitwiseAND(F.pow(F.lit(2), k).cast("int")) != 0))
    aside = F.pmod(F.xxhash64("value", F.lit(9)), F.lit(2)) == 1

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [v.encode("ascii", "replace").translate(DIGITS).decode() for v in b.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("aside"), pa.array(codes, pa.string())], ["kind", "aside", "code"])

    each = found.select("value", aside.alias("aside"), F.explode(of).alias("kind")).select("kind", (F.col("aside") & (F.col("kind") == len(KINDS))).alias("aside"), "value")
    return arrow_map(each, coded, "kind int, aside boolean, code string").groupBy("kind", "aside", "code").agg(F.count("*").alias("n"))


def prefix_tree(strings: DataFrame, kind: int, most_nodes: int, depth: int) -> tuple[list[dict[int, int]], np.ndarray]:
    """Children and counts of the prefixes of a kind's strings: the `most_nodes` commonest at most, and those that follow one of them by a step.

    Strings that part from the tree below, or at `depth`, count in all their prefixes that are in it.
    """
    own = strings.where((F.col("kind") == kind) & ~F.col("aside"))
    steps = own.select("n", "code", F.explode(F.sequence(F.lit(0), F.least(F.length("code"), F.lit(depth)))).alias("d"))
    steps = steps.select("n", F.substring("code", F.lit(1), F.col("d")).alias("prefix"), F.substring("code", F.col("d") + 1, F.lit(1)).alias("next"))
    signs = [*map(str, range(N_CLASSES)), ""]
    nodes = materialize(steps.groupBy("prefix").agg(F.sum("n").alias("n"), F.array(*(F.coalesce(F.sum(F.when(F.col("next") == x, F.col("n"))), F.lit(0)) for x in signs)).alias("counts")), "prefixes")
    # A prefix is as common as what follows it at least, so the common ones are a tree.
    common = nodes.select("prefix", "n").orderBy(F.desc("n"), F.length("prefix"), "prefix").limit(most_nodes)
    parent = F.substring("prefix", F.lit(1), F.length("prefix") - 1)
    kept = nodes.withColumn("_parent", F.when(F.col("prefix") != "", parent).otherwise("")).join(F.broadcast(common.select(F.col("prefix").alias("_parent"))), "_parent", "left_semi")
    rows = sorted(((r.prefix, r.counts) for r in kept.select("prefix", "counts").collect()), key=lambda r: (len(r[0]), r[0]))
    discard(nodes)
    number, children = {prefix: i for i, (prefix, _) in enumerate(rows)}, [{} for _ in rows]
    for prefix, i in number.items():
        if prefix:
            children[number[prefix[:-1]]][int(prefix[-1])] = i
    return children, np.array([c for _, c in rows], float)


def learn(docs: DataFrame, resolution: int = 2_000, most_nodes: int = 20_000, depth: int = 128, recounts: int = 1, least_rows: int = 8, false_rate: float = 1e-6, tail: float = 0.02) -> Formats:
    """Formats from all values and all ordinary tokens of docs: their prefixes, then their steps through the automata, then the gains of those held out.

    States are told apart as `resolution` strings with the shares of all strings would tell them: all ordinary tokens hold
    credentials without a label, too, for which an automaton of any number of states would have states of its own. What the
    ordinary automaton takes for credentials is left out when its steps are counted again, `recounts` times.
    """
    strings = materialize(all_strings(docs), "strings")
    sizes = {r.kind: r.n for r in strings.where(~F.col("aside")).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    kinds, ordinary = [k for k in range(len(KINDS)) if sizes.get(k, 0) >= least_rows], len(KINDS)
    found = Formats([], None, math.log(1 / false_rate))
    if kinds and sizes.get(ordinary):

        tables = {}
        for k in [*kinds, ordinary]:
            children, counts = prefix_tree(strings, k, most_nodes, depth)
            tables[k] = merged(children, counts * min(1.0, resolution / counts[0].sum()))[0]
        made = {k: automaton(tables[k], n) for k, n in counted(strings.where(~F.col("aside")), tables).items()}
        found.credentials, found.ordinary = [made[k] for k in kinds], made[ordinary]
        for _ in range(recounts):
            found.ordinary = automaton(tables[ordinary], counted(unlike(strings, found), {ordinary: tables[ordinary]})[ordinary])
        gains = gains_aside(strings, found)
        rank, above = int(tail * sum(n for _, n in gains)), 0
        for step, n in gains:
            above += n
            if above > rank:
                found.least_gain += max(0.0, step / STEPS - math.log(1 / tail))
                break
    discard(strings)
    return found


def unlike(strings: DataFrame, formats: Formats) -> DataFrame:
    """The ordinary strings to fit on that the formats don't take for credentials."""
    shared = strings.sparkSession.sparkContext.broadcast(formats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "code"):
            yield b.filter(pa.array(shared.value.gains_of(*decode(b.column("code").to_pylist())) < shared.value.least_gain))

    return arrow_map(strings.where(~F.col("aside") & (F.col("kind") == len(KINDS))), run, strings.schema)


def counted(strings: DataFrame, tables: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Steps of all strings of a kind through its automaton's states."""
    shared = strings.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((len(t), N_CLASSES + 1)) for k, t in shared.value.items()}
        for b in slices(batches, "code"):
            kinds, codes, times = b.column("kind").to_numpy(), b.column("code").to_pylist(), b.column("n").to_numpy()
            for k in set(kinds.tolist()) & set(total):
                of = np.flatnonzero(kinds == k)
                total[k] += visits(shared.value[k], *decode([codes[i] for i in of]), times[of])
        for k, t in total.items():
            state, c = np.nonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(state), k, np.int32)), pa.array(state), pa.array(c), pa.array(t[state, c].astype(np.int64))], ["kind", "state", "step", "n"])

    out = {k: np.zeros((len(t), N_CLASSES + 1)) for k, t in tables.items()}
    rows = arrow_map(strings.select("kind", "code", "n"), run, "kind int, state long, step long, n long")
    for r in rows.groupBy("kind", "state", "step").agg(F.sum("n").alias("n")).collect():
        out[r.kind][r.state, r.step] = r.n
    return out


def gains_aside(strings: DataFrame, formats: Formats) -> list[tuple[int, int]]:
    """(gain in STEPS of a nat, rounded up; number) of all ordinary tokens held out, the highest gain first."""
    shared = strings.sparkSession.sparkContext.broadcast(formats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "code"):
            # Gains below zero change nothing.
            steps = np.ceil(np.maximum(shared.value.gains_of(*decode(b.column("code").to_pylist())), 0) * STEPS).astype(np.int64)
            values, back = np.unique(steps, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.bincount(back, b.column("n").to_numpy()).astype(np.int64))], ["step", "n"])

    rows = arrow_map(strings.where(F.col("aside")).select("code", "n"), run, "step long, n long")
    return [(r.step, r.n) for r in rows.groupBy("step").agg(F.sum("n").alias("n")).orderBy(F.desc("step")).collect()]


def all_spans(texts: list[str], formats: Formats | Judge) -> list[list[tuple[int, int, int]]]:
    """Base and learnt spans (start, number of the kind, end) of each text, in order."""
    base = [base_spans(t) for t in texts]
    where = [(i, s, e) for i, (t, spans) in enumerate(zip(texts, base, strict=True)) for s, e in free_tokens(t, spans)]
    out = [list(x) for x in base]
    for (i, s, e), hit in zip(where, list(formats.learnt([texts[i][s:e] for i, s, e in where])), strict=True):
        if hit:
            out[i].append((s, len(KINDS), e))
    return [sorted(x) for x in out]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, LEARNT)[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base spans), base_sha256 and spans of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(formats or learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for b in slices(batches, "text"):
            found = all_spans([t or "" for t in b.column("text").to_pylist()], judge)
            base = [[x for x in own if x[1] < len(KINDS)] for own in found]
            n = [pa.array([sum(x[1] == k for x in own) for own in base], pa.int64()) for k in range(len(KINDS))]
            digest = [hashlib.sha256(written(own).encode()).hexdigest() for own in base]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *n, pa.array(digest), pa.array([written(x) for x in found])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return arrow_map(id_and_text(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame, formats: Formats | None = None, mark: str = "[secret]") -> DataFrame:
    """docs with every span of their texts replaced by a mark; n_chars, if there, is made anew for changed texts."""
    shared = docs.sparkSession.sparkContext.broadcast(formats or learn(docs))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            out = []
            for t, spans in zip(texts, all_spans([t or "" for t in texts], judge), strict=True):
                kept, at = [], 0
                for s, _, e in spans:
                    if s >= at:
                        kept += [t[at:s], mark]
                    at = max(at, e)
                out.append(t if not spans else "".join(kept) + t[at:])
            made = {"text": pa.array(out, pa.string())}
            if "n_chars" in names:
                chars = [n if new == old else len(new) for n, new, old in zip(b.column("n_chars").to_pylist(), out, texts, strict=True)]
                made["n_chars"] = pa.array(chars, b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([made[c].cast(b.schema.field(c).type) if c in made else b.column(c) for c in names], names)

    return arrow_map(docs, run, docs.schema)
