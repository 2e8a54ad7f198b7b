"""Language by cross-parsing: how few phrases of a language's sample does it take to write the text?

One suffix automaton per language holds every substring of a sample of its labelled text. A text is parsed from left to
right; each phrase is the longest match the automaton still allows. The language that needs the fewest phrases per
character wins. Automata become sparse transition tables, so that many texts are parsed abreast: the rows of all states
are laid over each other in one array so that their entries do not collide, each marked with its state. Long texts are
parsed in lanes; where a phrase runs across the border of two lanes, the parse of the second is redone until it meets
the one that began at the border, so the count is that of the whole text.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.llm.shared import blocks, shared_object, strings, written

CLASSES = 0x110000
UNKNOWN = 0


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every suffix of the sequence; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        now = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = now
            p = link[p]
        if p != -1:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return edges


def alphabet(texts: list[str]) -> dict[str, int]:
    """Codes of all lower-case letters that occur; 1 is any run of other characters, 0 an unseen letter."""
    return {c: i + 2 for i, c in enumerate(sorted({c for text in texts for c in text.lower() if c.isalpha()}))}


@functools.cache
def letters_of_unicode() -> tuple[np.ndarray, dict[str, list[int]]]:
    """Code points that are letters, and those that share a lower-case letter."""
    points = [p for p in range(CLASSES) if chr(p).isalpha()]
    shared: dict[str, list[int]] = {}
    for p in points:
        shared.setdefault(chr(p).lower(), []).append(p)
    return np.array(points), shared


def code_table(letters: dict[str, int]) -> np.ndarray:
    """Code of every Unicode character: its lower-case letter's, 0 for other letters, 1 for the rest."""
    points, shared = letters_of_unicode()
    table = np.ones(CLASSES, np.int32)
    table[points] = UNKNOWN
    for c, code in letters.items():
        table[shared.get(c, [])] = code
    return table


def encode(text: str, table: np.ndarray) -> np.ndarray:
    """Codes of a text; runs of characters that are no letters become one."""
    codes = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    gap = codes == 1
    return codes[~(gap & np.concatenate([[False], gap[:-1]]))] if codes.size else codes


def equal_shares(texts: list[str], chars: int) -> list[str]:
    """The beginnings of texts, `chars` characters together: as much of each as of any other that is long enough."""
    left, shares = chars, {}
    for nth, i in enumerate(sorted(range(len(texts)), key=lambda i: (len(texts[i]), i))):
        shares[i] = min(len(texts[i]), left // (len(texts) - nth))
        left -= shares[i]
    return [text[: shares[i]] for i, text in enumerate(texts)]


def overlay(edges: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base of every state, owner and target of every slot): a state's edge by c is in slot base + c, if it owns it.

    States with several edges are laid at random into a region four times as large as their edges, the ones with most
    edges first; states with one edge take one slot each behind it.
    """
    many = sorted((s for s, row in enumerate(edges) if len(row) > 1), key=lambda s: (-len(edges[s]), s))
    size = 4 * sum(len(edges[s]) for s in many) + 2 * width
    rng, base = random.Random(0), np.zeros(len(edges), np.int32)
    owner, target = [-1] * size, [-1] * size
    for state in many:
        row, tries = edges[state], 0
        at = rng.randrange(size - width)
        while any(owner[at + c] >= 0 for c in row):
            tries += 1
            if tries % 200 == 0:
                owner, target, size = owner + [-1] * size, target + [-1] * size, 2 * size
            at = rng.randrange(size - width)
        base[state] = at
        for c, to in row.items():
            owner[at + c], target[at + c] = state, to
    for state, row in enumerate(edges):
        if len(row) == 1:
            (c, to), = row.items()
            base[state] = len(owner) - c
            owner.append(state)
            target.append(to)
    pad = [-1] * width  # so that every base plus every code is a slot
    return base, np.array(owner + pad, np.int32), np.array(target + pad, np.int32)


class Model:
    def __init__(self, samples: dict[str, list[str]], chars: int):
        """Automata of about `chars` characters of sample text each, an equal share of every text."""
        self.names, self.table = sorted(samples), None
        parts = {name: equal_shares(texts, chars) for name, texts in samples.items()}
        self.letters = alphabet([t for texts in parts.values() for t in texts])
        table = code_table(self.letters)
        self.width = len(self.letters) + 2
        bases, owners, targets, states, slots = [], [], [], 0, 0
        self.first = np.zeros((len(self.names), self.width), np.int32)  # where a phrase that begins with a letter leads
        self.starts = []
        for k, name in enumerate(self.names):
            codes = np.concatenate([np.ones(1, np.int32)] + [np.append(encode(t, table), np.int32(1)) for t in parts[name]])
            edges = suffix_automaton([c for c in codes.tolist() if c != UNKNOWN]) + [{}]
            nothing = states + len(edges) - 1  # where a parse starts and a character leads that no phrase begins with
            self.first[k] = nothing
            for c, state in edges[0].items():
                self.first[k, c] = states + state
            base, owner, target = overlay([{}, *edges[1:]], self.width)
            bases.append(base + slots)
            owners.append(np.where(owner >= 0, owner + states, -1))
            targets.append(np.where(target >= 0, target + states, -1))
            states, slots = states + len(edges), slots + owner.size
            self.starts.append(nothing)
        self.base, self.owner, self.target = (np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int32) for x in (bases, owners, targets))

    def codes(self) -> np.ndarray:
        """The code table, made where it is first needed rather than sent."""
        if self.table is None:
            self.table = code_table(self.letters)
        return self.table

    def step(self, lang: np.ndarray, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, does a phrase begin?) for each state and the code it reads."""
        slot = self.base.take(state) + codes
        on = self.owner.take(slot) == state
        return np.where(on, self.target.take(slot), self.first[lang, codes]), ~on

    def parse(self, lang: int, state: int, codes: np.ndarray) -> tuple[int, int]:
        """(last state, phrases begun) of one lane."""
        base, owner, target, first, n = self.base.item, self.owner.item, self.target.item, self.first[lang].item, 0
        for c in codes.tolist():
            slot = base(state) + c
            if owner(slot) == state:
                state = target(slot)
            else:
                state = first(c)
                n += 1
        return state, n

    def phrases(self, texts: list[np.ndarray], lane: int = 512) -> np.ndarray:
        """Phrases per text and language, in lanes of `lane` characters abreast."""
        sizes = np.array([t.size for t in texts], np.int64)
        per_text = -(-sizes // lane)
        owner = np.repeat(np.arange(sizes.size), per_text)
        nth = np.arange(owner.size) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        length = np.minimum(sizes[owner] - nth * lane, lane)
        first = (np.cumsum(sizes) - sizes)[owner] + nth * lane
        order = np.argsort(-length, kind="stable")
        codes = np.concatenate([*texts, np.zeros(1, np.int32)])
        langs = len(self.names)
        lang = np.arange(langs)[:, None]
        state = np.repeat(np.array(self.starts, np.int32)[:, None], owner.size, axis=1)
        count = np.zeros((langs, owner.size), np.int64)
        active = np.searchsorted(-length[order], -np.arange(lane), side="left")  # lanes longer than t
        moved, begun = state[:, order], np.zeros_like(count)
        for t in range(int(length.max(initial=0))):
            n = active[t]
            moved[:, :n], begins = self.step(lang, moved[:, :n], codes[first[order[:n]] + t])
            begun[:, :n] += begins
        state[:, order], count[:, order] = moved, begun
        # a lane that follows another begins in that one's last state: both parses go on until they meet
        k, at = np.nonzero(np.broadcast_to(nth > 0, state.shape))
        entered = np.where(nth > 0, np.roll(state, 1, axis=1), state)
        old, new = np.array(self.starts, np.int32)[k], entered[k, at].copy()
        more, apart = np.zeros(k.size, np.int64), np.flatnonzero(old != new)
        for t in range(lane):
            apart = apart[length[at[apart]] > t]
            if not apart.size:
                break
            read = codes[first[at[apart]] + t]
            a, begins_a = self.step(k[apart], old[apart], read)
            b, begins_b = self.step(k[apart], new[apart], read)
            old[apart], new[apart] = a, b
            more[apart] += begins_b.astype(np.int64) - begins_a
            apart = apart[a != b]
        count[k, at] += more
        # where they did not meet within the lane, the lanes behind it are parsed one after the other
        apart = np.flatnonzero(old != new)
        state[k[apart], at[apart]] = new[apart]
        for i in apart.tolist():
            lang_, lane_ = int(k[i]), int(at[i]) + 1
            while lane_ < owner.size and nth[lane_] > 0 and state[lang_, lane_ - 1] != entered[lang_, lane_]:
                entered[lang_, lane_] = state[lang_, lane_ - 1]
                end, n = self.parse(lang_, int(entered[lang_, lane_]), codes[first[lane_] : first[lane_] + length[lane_]])
                same = end == state[lang_, lane_]
                state[lang_, lane_], count[lang_, lane_] = end, n
                if same:
                    break
                lane_ += 1
        out = np.zeros((langs, sizes.size), np.int64)
        for k in range(langs):
            out[k] = np.bincount(owner, count[k], sizes.size)
        return out.T


def sample_texts(labelled: DataFrame, rows: int, chars: int, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """The first `chars` characters of about `rows` labelled texts per language, picked by a hash of their id: a rate per
    language from its row count."""
    counts = written(labelled.groupBy(F.col(lang_col).alias("__lang")).agg(F.count("*").alias("__rows")), "languages")
    counts = F.broadcast(counts) if counts.count() <= 100_000 else counts  # one row per language
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.join(counts, F.col(lang_col) == F.col("__lang")).where(draw * F.col("__rows") < rows)
    samples: dict[str, list[str]] = {}
    for r in chosen.select("__lang", F.col(id_col).alias("id"), F.substring(text_col, 1, chars).alias("text")).orderBy("id", "text").collect():
        samples.setdefault(r["__lang"], []).append(r["text"])
    return samples


def identify(docs: DataFrame, held_out: Column, sample_rows: int = 96, chars: int = 32_000, sharpness: float = 12.0, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang", keep_columns: bool = False) -> DataFrame:
    """Language of every whole text: doc_id, held_out, lang_pred, score; with `keep_columns` all columns of `docs` instead
    of doc_id, less any of those three names.

    Automata are learned from rows that are not `held_out` and have a language: about `sample_rows` texts of each, of
    which `chars` characters, an equal share of every text, make the automaton, with all their letters. The score is the winner's share of the languages' phrase rates to the
    power -sharpness; ties go to the first name. A text that is null or has no letter is `und` with score 0, and so is
    every text if nothing is labelled. Null ids are kept; repeated rows are scored each.
    """
    labelled = docs.where(~held_out & F.col(lang_col).isNotNull() & (F.length(F.trim(F.col(text_col))) > 0))
    model = Model(sample_texts(labelled, sample_rows, chars, id_col, text_col, lang_col), chars)
    shared = shared_object(docs.sparkSession, model)  # at most 2 * chars states per language

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared()
        table = m.codes()
        for batch in batches:
            texts = strings(batch, text)
            for lo, hi in blocks(np.array([len(t) for t in texts]), 2_000_000):
                codes = [encode(t, table) for t in texts[lo:hi]]
                usable = np.array([bool((c != 1).any()) for c in codes]) & bool(m.names)
                names, scores = np.full(hi - lo, "und", object), np.zeros(hi - lo)
                at = np.flatnonzero(usable)
                if at.size:
                    counts = m.phrases([codes[i] for i in at])
                    best = counts.argmin(axis=1)
                    least = counts[np.arange(at.size), best]
                    names[at] = np.array(m.names, object)[best]
                    scores[at] = 1.0 / ((least[:, None] / counts) ** sharpness).sum(axis=1)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores)], names=[*kept, "lang_pred", "score"])

    if keep_columns:
        rows, text = docs.withColumn("held_out", held_out).drop("lang_pred", "score"), text_col
        kept = rows.columns
    else:
        rows, text, kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text")), "text", ["doc_id", "held_out"]
    schema = StructType([*(rows.schema[c] for c in kept), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(score, schema)
