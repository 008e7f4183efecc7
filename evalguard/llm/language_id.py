"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of its labelled text is built. A text is
parsed greedily into the longest phrases that occur in that sample; the language whose code length,
phrases times log2 of the sample's length, is least wins. Walking the automaton from its root is
the longest-match search, so a phrase ends where no transition leads on.

The automata of all languages share sparse tables (rows laid into each other's gaps, so that a table grows with the
transitions, not with states times alphabet), and texts are walked in parallel lanes by array operations.
Lanes begin every ``BLOCK`` characters as if a phrase began there; where the phrase that crosses into
a block ends elsewhere, the block is walked again from that place until both parses meet. The result is the
greedy parse of the whole text, whatever the block size and the batch.

Defined cases: a null text, or one without a letter of any script, is ``und`` with score 0; a text of any length is parsed
whole; ties go to the language that sorts first; repeated rows get the same result, and a repeated id teaches once; documents with null
ids are predicted and never learned from; with no labelled text at all every prediction is ``und``; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalguard.llm.common import in_arrow, materialise

UNDETERMINED = "und"
BLOCK = 256
#: Bound of the training sample: rows and characters for each language. Texts are learned whole.
SAMPLE_ROWS, SAMPLE_CHARS = 256, 32_000
#: Characters parsed at once; a longer text stands alone.
PART_CHARS = 1 << 18
#: Characters past a block that all its lanes look for the end of their phrase; longer ones are followed one by one.
AHEAD = 48
#: So few lanes are walked one by one.
FEW = 64


class SuffixAutomaton:
    """Blumer et al.'s online construction; only forward transitions are kept."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def phrases(self, text: str) -> int:
        """Number of greedy longest-match phrases; a character unknown to the sample is a phrase of its own."""
        n, state, inside = 0, 0, False
        for c in text:
            to = self.next[state].get(c)
            if to is None:
                n += inside
                to = self.next[0].get(c)
                if to is None:
                    n += 1
                    inside, state = False, 0
                    continue
            inside, state = True, to
        return n + inside


def normalise(text: str) -> str:
    """Lower case; whatever isn't a letter becomes a space."""
    return "".join(c if c.isalpha() else " " for c in text.lower())


@dataclass
class Model:
    """All automata in one sparse table. A state is the place of its row: the step with a symbol is at ``state + symbol``, if the upper half there is the state.

    Roots have no row: a step that isn't there begins a phrase, by ``first``.
    """

    langs: list[str]
    bits: list[float]  # of a phrase, by language
    alphabet: str  # symbols from 1 on; 0 is unknown
    roots: np.ndarray
    table: np.ndarray  # state << 32 | next state; -1 where there is none
    first: np.ndarray  # by symbol and language: the state after a phrase's first character, the root if the sample lacks it


def lay_out(rows: list[dict[int, int]]) -> tuple[list[int], np.ndarray]:
    """(place of each row, table) of rows of symbol -> row: wide rows first, each where its entries fall into gaps, or behind all others."""
    widest = max((max(r) for r in rows if r), default=0)
    used = bytearray(2 * sum(map(len, rows)) + len(rows) + 2 * widest + 2)
    taken: set[int] = set()
    places = [0] * len(rows)
    low, end = widest, widest  # no gap before, nothing behind
    for i in sorted(range(len(rows)), key=lambda i: -len(rows[i])):
        symbols = sorted(rows[i]) or [0]
        at = low = used.index(0, low)
        for _ in range(32):
            start = at - symbols[0]
            if start not in taken and (at >= end or not any(used[start + c] for c in symbols)):
                break
            at = used.index(0, at + 1)
        else:
            start = end - symbols[0]
            while start in taken:
                start += 1
        if start + 2 * widest + 2 > len(used):
            used.extend(bytes(len(used) // 4 + 2 * widest + 2))
        places[i] = start
        taken.add(start)
        for c in rows[i]:
            used[start + c] = 1
        end = max(end, start + symbols[-1] + 1)
    table = np.full(max([*places, end]) + widest + 1, -1, np.int64)
    for start, row in zip(places, rows, strict=True):
        for c, to in row.items():
            table[start + c] = start << 32 | places[to]
    return places, table


def train(samples: dict[str, str]) -> Model:
    """A model of labelled text by language."""
    samples = {k: normalise(v) for k, v in sorted(samples.items()) if normalise(v).strip()}
    alphabet = "".join(sorted(set("".join(samples.values()))))
    symbol = {c: i + 1 for i, c in enumerate(alphabet)}
    rows: list[dict[int, int]] = []
    roots = []
    for text in samples.values():
        root = len(rows)
        rows += [{symbol[c]: root + to for c, to in row.items()} for row in SuffixAutomaton(text).next]
        roots.append(root)
    starts = [rows[r] for r in roots]
    for r in roots:
        rows[r] = {}
    places, table = lay_out(rows)
    first = np.zeros((len(alphabet) + 1, len(roots)), np.int64)
    for i, root in enumerate(roots):
        first[:, i] = places[root]
        for c, to in starts[i].items():
            first[c, i] = places[to]
    return Model(list(samples), [math.log2(max(2, len(t))) for t in samples.values()], alphabet, np.array([places[r] for r in roots], np.int64), table, first)


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter; one table for each worker process."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Parser:
    """Counts the phrases of many texts for all languages of a model."""

    def __init__(self, model: Model, block: int = BLOCK) -> None:
        self.model, self.block = model, block
        self.symbol = np.zeros(0x110000, np.uint8 if len(model.alphabet) < 255 else np.int32)
        self.letter = _letters()
        self.symbol[~self.letter] = model.alphabet.find(" ") + 1
        for i, c in enumerate(model.alphabet):
            self.symbol[ord(c)] = i + 1
        self.flat, self.first = memoryview(model.table), model.first.T.tolist()

    def _step(self, state: np.ndarray, symbol: np.ndarray, lang: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(next state, whether a phrase begins with this symbol); lanes are rows of all languages, or single with their ``lang``."""
        m = self.model
        entry = m.table.take(state + (symbol if lang is not None else symbol[:, None]))
        begins = (entry >> 32) != state
        entry &= 0xFFFFFFFF
        return np.where(begins, m.first[symbol, lang] if lang is not None else m.first.take(symbol, axis=0), entry), begins

    def _follow(self, symbols: np.ndarray, state: int, place: int, stop: int) -> int:
        """Where the phrase that is open before ``place`` ends."""
        table = self.flat
        for c in symbols[place:stop].tolist():
            entry = table[state + c]
            if entry >> 32 != state:
                return place
            state = entry & 0xFFFFFFFF
            place += 1
        return stop

    def _meet(self, symbols: np.ndarray, state: int, place: int, end: int, stop: int, begin: int, lang: int, marks: memoryview) -> tuple[int, int, bool]:
        """(phrases begun, place, True) where the parse meets the block's own, or (phrases begun, where its last phrase ends past the block, False)."""
        table, first, n = self.flat, self.first[lang], 0
        for c in symbols[place:end].tolist():
            entry = table[state + c]
            if entry >> 32 == state:
                state = entry & 0xFFFFFFFF
            else:
                n += 1
                if marks[place - begin]:
                    return n, place, True
                state = first[c]
            place += 1
        return n, self._follow(symbols, state, place, stop), False

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by text and language, whether the text has a letter)."""
        n_lang, size = len(self.model.langs), self.block
        lower = [t.lower() for t in texts]
        sizes = np.fromiter(map(len, lower), np.int64, len(lower))
        points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        letter_at = np.flatnonzero(self.letter[points])
        has_letter = np.searchsorted(letter_at, offsets[1:]) > np.searchsorted(letter_at, offsets[:-1])
        if not n_lang or not len(points):
            return np.zeros((len(texts), n_lang), np.int64), has_letter
        symbols = np.append(self.symbol[points], self.symbol.dtype.type(0)).astype(np.int64)
        blocks = -(-sizes // size)
        doc = np.repeat(np.arange(len(texts)), blocks)
        begin = np.repeat(offsets[:-1] - size * (np.cumsum(blocks) - blocks), blocks) + size * np.arange(len(doc))
        stop = offsets[1:][doc]
        end = np.minimum(begin + size, stop)
        phrases = self._joined(symbols, begin, end, stop, doc, *self._blocks(symbols, begin, end, stop))
        cut = np.concatenate([np.zeros((1, n_lang), np.int64), np.cumsum(phrases, axis=0, dtype=np.int64)])
        edges = np.concatenate([[0], np.cumsum(blocks)])
        return cut[edges[1:]] - cut[edges[:-1]], has_letter

    def _blocks(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parses of single blocks: where phrases begin (place in the block, block, language), the first place past the block where one does, and the state there.

        A phrase that goes on for ``AHEAD`` characters is left where it is: the place is negative, and the state that of the place it names.
        """
        n_lang, n = len(self.model.langs), len(begin)
        length = end - begin
        order = np.argsort(-length, kind="stable")  # at each step the first lanes still have text
        live = np.searchsorted(-length[order], -np.arange(self.block + 1), "left")
        marks = np.zeros((int(length.max()), n, n_lang), bool)
        state = np.tile(self.model.roots, (n, 1))
        start = begin[order]
        for k in range(len(marks)):
            m = int(live[k])
            state[:m], marks[k, :m] = self._step(state[:m], symbols[start[:m] + k])
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        marks, last = marks.take(back, axis=1), state[back]
        leave = np.repeat(end[:, None], n_lang, axis=1)
        block, lang = np.nonzero(np.repeat((end < stop)[:, None], n_lang, axis=1))
        place, state = end[block], last[block, lang]
        for _ in range(AHEAD):
            if not len(block):
                break
            state, begins = self._step(state, symbols[place], lang)
            place += ~begins
            out = begins | (place >= stop[block])
            leave[block[out], lang[out]] = place[out]
            on = ~out
            block, lang, state, place = block[on], lang[on], state[on], place[on]
        leave[block, lang] = -place
        last[block, lang] = state
        return marks, leave, last

    def _joined(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, stop: np.ndarray, doc: np.ndarray, marks: np.ndarray, leave: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Phrases that begin in each block, by language, when each block is entered where the one before it was left.

        Each round walks blocks whose entry has become known or changed, until they meet their own parse.
        """
        n_lang, top = len(self.model.langs), len(marks) - 1
        done = np.cumsum(marks, axis=0, dtype=np.int32)
        phrases = done[-1].copy()

        def left(block: np.ndarray, lang: np.ndarray) -> np.ndarray:
            """Where single parses leave their blocks; long phrases are followed once, when they are asked for."""
            out = leave[block, lang]
            for i in np.flatnonzero(out < 0).tolist():
                b, la = block[i], lang[i]
                out[i] = leave[b, la] = self._follow(symbols, int(last[b, la]), -int(out[i]), int(stop[b]))
            return out

        flat = memoryview(marks.reshape(-1))
        inner = np.append(doc[1:] == doc[:-1], False)  # blocks with another one after them in their text
        head = np.append(True, doc[1:] != doc[:-1])
        block, lang = np.nonzero(np.repeat((inner & head)[:, None], n_lang, axis=1))
        left(block, lang)
        own = leave.copy()
        block, lang = np.nonzero((own >= 0) & inner[:, None])
        enter = own[block, lang]
        block = block + 1
        while len(block):
            new = own[block, lang]  # where the blocks are left from now on
            phrases[block, lang] = 0
            past = enter >= end[block]
            new[past] = enter[past]
            i = np.flatnonzero(~past)
            place, state = enter[i], self.model.roots[lang[i]]
            while len(i):
                if len(i) < FEW:
                    for j in range(len(i)):
                        b, la = int(block[i[j]]), int(lang[i[j]])
                        n, at, met = self._meet(symbols, int(state[j]), int(place[j]), int(end[b]), int(stop[b]), int(begin[b]), la, flat[b * n_lang + la :: len(begin) * n_lang])
                        phrases[b, la] += n
                        if met:
                            phrases[b, la] += done[-1, b, la] - done[at - begin[b], b, la]
                            at = left(block[i[j : j + 1]], lang[i[j : j + 1]])[0]
                        new[i[j]] = at
                    break
                b, la = block[i], lang[i]
                state, begins = self._step(state, symbols[place], la)
                at = place - begin[b]
                met = begins & marks[np.minimum(at, top), b, la]
                phrases[b, la] += begins
                phrases[b[met], la[met]] += done[-1, b[met], la[met]] - done[at[met], b[met], la[met]]
                new[i[met]] = left(b[met], la[met])
                place = place + 1
                out = ~met & (place >= end[b])
                for j in np.flatnonzero(out).tolist():
                    new[i[j]] = self._follow(symbols, int(state[j]), int(place[j]), int(stop[b[j]]))
                on = ~(met | out)
                i, state, place = i[on], state[on], place[on]
            changed = new != own[block, lang]
            own[block, lang] = new
            again = changed & inner[block]
            block, lang, enter = block[again] + 1, lang[again], new[again]
        return phrases


def whole_texts(lengths: list[int], chars: int) -> list[int]:
    """Which texts to learn from, in the order given: whole ones as long as they fit into ``chars``, else the first of the shortest."""
    out, left = [], chars
    for i, n in enumerate(lengths):
        if n <= left:
            out.append(i)
            left -= n
    return out or ([lengths.index(min(lengths))] if lengths else [])


def collect_sample(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Bounded training text by language from (doc_id, text, lang).

    For each language and each of ``rows`` hash buckets the row of the least hash is chosen from ids alone, by a
    map-side aggregate; of rows with the same id one teaches. Whole texts are learned, in hash order, as long as they fit into
    ``chars`` characters a language. Only where every chosen text of a language is longer does its shortest
    teach, by pieces of some thousand characters at even distances over all of it.
    """
    spark = labelled.sparkSession
    labelled = labelled.select("lang", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = labelled.where("lang is not null and doc_id is not null and text is not null").select("doc_id", "lang", F.xxhash64(F.lit("sample"), "doc_id").alias("h"))
    chosen = [(r["lang"], r["pick"]["doc_id"], r["pick"]["h"]) for r in keyed.groupBy("lang", F.pmod("h", F.lit(rows)).alias("bucket")).agg(F.min(F.struct("h", "doc_id")).alias("pick")).select("lang", "pick").collect()]
    if not chosen:
        return {}
    ids = spark.createDataFrame(chosen, "lang string, doc_id long, h long")
    found = labelled.where("text is not null").join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "h", "doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("th"), F.col("text").alias("text"))).alias("r"))
    texts = materialise(found.select("lang", "h", "doc_id", "r.text", F.char_length("r.text").alias("n")).where("n > 0"), "lang-sample")
    by_lang: dict[str, list] = {}
    for r in texts.select("lang", "h", "doc_id", "n").orderBy("lang", "h", "doc_id").collect():
        by_lang.setdefault(r["lang"], []).append(r)
    taken = [(lang, r[i]["doc_id"]) for lang, r in by_lang.items() for i in whole_texts([x["n"] for x in r], chars)]
    if not taken:
        return {}
    size, n = F.lit(chars), max(1, chars // 1000)
    pieces = F.when(F.col("n") <= size, F.col("text")).otherwise(F.concat_ws("\n", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.expr("text").substr((i * (F.col("n") - chars // n) / max(1, n - 1)).cast("int") + 1, F.lit(chars // n)))))
    got = texts.join(F.broadcast(spark.createDataFrame(taken, "lang string, doc_id long")), ["lang", "doc_id"]).select("lang", "h", "doc_id", pieces.alias("text")).orderBy("lang", "h", "doc_id").collect()
    out: dict[str, str] = {}
    for r in got:
        out[r["lang"]] = f"{out[r['lang']]}\n{r['text']}" if r["lang"] in out else r["text"]
    return out


def score(counts: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best language and its share of probability, the code lengths read as -log2 of likelihoods."""
    length = counts * bits[None, :]
    best = length.argmin(axis=1)
    gap = np.minimum(length - length.min(axis=1, keepdims=True), 1000.0)
    return best, 1.0 / np.exp2(-gap).sum(axis=1)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, phrases) of every whole text; ``phrases`` are those of the winner."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, text_hash long, lang_pred string, score double, phrases long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(shared.value)
        bits = np.array(parser.model.bits)
        names = np.array([*parser.model.langs, UNDETERMINED], dtype=object)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part, size = [], 0
                while at + len(part) < batch.num_rows and size < PART_CHARS:
                    part.append(batch.column(2)[at + len(part)].as_py() or "")
                    size += len(part[-1])
                counts, has = parser.count(part)
                if len(bits):
                    best, share = score(counts, bits)
                else:
                    best, share, has = np.zeros(len(part), np.int64), np.zeros(len(part)), np.zeros(len(part), bool)
                phrases = counts[np.arange(len(part)), best] if len(bits) else np.zeros(len(part), np.int64)
                lang = names[np.where(has, best, len(bits))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(lang, pa.string()), pa.array(np.where(has, share, 0.0)), pa.array(phrases, pa.int64())],
                    ["doc_id", "text_hash", "lang_pred", "score", "phrases"],
                )
                at += len(part)

    text = F.col("text").cast("string")
    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")), run, schema)
