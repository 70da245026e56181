"""Held-out passages inside a training corpus: one Aho-Corasick automaton over normalised items, each text scanned once.

Normalisation decomposes characters, folds case and keeps letters and digits only, so accents, spacing, punctuation, line-end
hyphens and equivalent forms vanish on both sides.  The automaton's patterns are all runs of so many words (characters
in scripts without spaces) of an item as a stretch of a third of it with one word in eight wrong must hold unbroken, so every
true case has hits, and a number of different ones that no true case falls short of; documents with fewer are done.  A hit is aligned word by word in both directions, with
wrong, mistyped or missing words skipped; a case counts if some run of item words is long enough and has few enough skipped.
That walk takes the first place where the words go on.  Where it finds no case though there are hits enough, the best chain over all
places of the item's words near the hits is found by dynamic programming, so a jump to a wrong place loses nothing.

The items are the stated query set.  They are read once, in blocks of a bounded size (one automaton each), and every block meets all
documents; the corpus is never shuffled or gathered.

Defined results: null and empty texts hold nothing and leak nowhere; an item without letters has no case; repeated documents
are cases each; an item that stands in a document several times is one case, with its longest stretch.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most words (characters in scripts without spaces) that a pattern has.
RUN_WORDS, RUN_CHARS = 5, 6
LEAST_SHARE, WRONG_SHARE = 3, 8  # a third of the words; one word in eight
#: Characters of item text in one automaton (some hundred MB in memory at most).
BLOCK_CHARS = 2_000_000
NOT_WORD = re.compile(r"[\W_]+")
UNSPACED = ("ja", "zh")
#: Letters of scripts written without spaces between words.
UNSPACED_LETTER = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
#: How far a wrong word may reach beyond its length in the document, in characters.
SLACK = 16
#: How many words may be skipped in a row, and how many characters of words (of unspaced scripts) must fit to go on.
LOOKAHEAD, PROBE_WORDS, PROBE_CHARS = 8, 6, 4


def flat(text: str) -> str:
    """Letters and digits of a text in one form."""
    return NOT_WORD.sub("", unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold()))


def flat_positions(text: str) -> list[int]:
    """Position in ``text`` of each character of ``flat(text)``."""
    known: dict[str, int] = {}
    out: list[int] = []
    for at, c in enumerate(text):
        n = known.get(c)
        if n is None:
            n = known[c] = len(flat(c))
        out.extend([at] * n)
    return out


@dataclass(frozen=True)
class Item:
    """An item's number, its normalised words (characters in unspaced scripts), and the length of its patterns.

    ``ends`` are the words' ends in the item; ``ahead`` and ``behind`` hold, for each word, it and so many after or before it as
    make a probe that is rare enough to go on from.
    """

    number: int
    words: tuple[str, ...]
    run: int
    slack: int = 0
    ends: tuple[int, ...] = ()
    ahead: tuple[str, ...] = ()
    behind: tuple[str, ...] = ()
    hits: int = 1


def sure_run(n: int) -> int:
    """Right words in a row that any stretch of a third of ``n`` words has, at most one in eight being wrong."""
    return min((-(-(size - size // WRONG_SHARE) // (size // WRONG_SHARE + 1)) for size in range(max(1, -(-n // LEAST_SHARE)), n + 1)), default=0)


def sure_hits(n: int, run: int) -> int:
    """Different patterns of ``run`` words that any such stretch holds; each wrong word spoils at most ``run`` of them."""
    sizes = range(max(1, -(-n // LEAST_SHARE)), n + 1)
    return min((max(1, size - size // WRONG_SHARE - (size // WRONG_SHARE + 1) * (run - 1)) for size in sizes), default=1)


def item_of(number: int, text: str, lang: str | None) -> Item:
    plain = flat(text)
    unspaced = (lang or "").lower()[:2] in UNSPACED or len(UNSPACED_LETTER.findall(plain)) * 2 > len(plain)
    words = tuple(plain) if unspaced else tuple(w for w in map(flat, re.sub(r"-\s*\n\s*|\u00ad", "", text).split()) if w)
    need, ahead, behind = PROBE_CHARS if unspaced else PROBE_WORDS, [], []
    for k in range(len(words)):
        i = j = k
        while sum(map(len, words[k : i + 1])) < need and i + 1 < len(words):
            i += 1
        while sum(map(len, words[j : k + 1])) < need and j:
            j -= 1
        ahead.append("".join(words[k : i + 1]))
        behind.append("".join(words[j : k + 1]))
    run = min(sure_run(len(words)), RUN_CHARS if unspaced else RUN_WORDS)
    return Item(number, words, run, 2 if unspaced else SLACK, tuple(accumulate(map(len, words))), tuple(ahead), tuple(behind), sure_hits(len(words), run))


def automaton_of(items: list[Item]):
    """Automaton whose patterns end at ``(length, [(item index, first word)])``."""
    import ahocorasick

    where: dict[str, list[tuple[int, int]]] = {}
    for k, item in enumerate(items):
        for i in range(len(item.words) - item.run + 1) if item.run else ():
            where.setdefault("".join(item.words[i : i + item.run]), []).append((k, i))
    found = ahocorasick.Automaton()
    for pattern, at in where.items():
        found.add_word(pattern, (len(pattern), at))
    if where:
        found.make_automaton()
    return found if where else None


def aligned(item: Item, text: str, i: int, at: int, forward: bool) -> list[tuple[int, int, int]]:
    """Words that follow (or precede) an anchor, as ``(word, start, end)`` of those that are there.

    ``i`` is the next word, ``at`` the place where it should begin (or end).  A word that is not there is skipped; the text goes on
    where the next words fit again, with the fewest words skipped.  Words between two wrong ones are then looked for in the gap.
    """
    out: list[tuple[int, int, int]] = []
    words, ends, n, end = item.words, item.ends, len(item.words), len(text)
    ahead = max(LOOKAHEAD, n // WRONG_SHARE)  # all wrong words that a stretch of the item may have can be neighbours
    if forward:
        while i < n and at < end:
            w = words[i]
            if text.startswith(w, at):
                stop = at + len(w)
                out.append((i, at, stop))
                i, at = i + 1, stop
                continue
            before = ends[i - 1] if i else 0
            for s in range(1, min(ahead, n - 1 - i) + 1):
                probe = item.ahead[i + s]
                if len(probe) >= 3:
                    q = text.find(probe, at, at + ends[i + s - 1] - before + s * item.slack + len(probe))
                    if q >= 0:
                        for k in range(i, i + s):
                            r = text.find(words[k], at, q)
                            if r >= 0:
                                at = r + len(words[k])
                                out.append((k, r, at))
                        i, at = i + s, q
                        break
            else:
                break
        return out
    while i >= 0 and at > 0:
        w = words[i]
        start = at - len(w)
        if start >= 0 and text.startswith(w, start):
            out.append((i, start, at))
            i, at = i - 1, start
            continue
        for s in range(1, min(ahead, i) + 1):
            probe = item.behind[i - s]
            if len(probe) >= 3:
                q = text.rfind(probe, max(0, at - (ends[i] - ends[i - s]) - s * item.slack - len(probe)), at)
                if q >= 0:
                    low = q + len(probe)
                    for k in range(i, i - s, -1):
                        r = text.rfind(words[k], low, at)
                        if r >= 0:
                            out.append((k, r, r + len(words[k])))
                            at = r
                    i, at = i - s, low
                    break
        else:
            break
    return out


def longest(there: list[bool], least: int) -> tuple[int, int] | None:
    """Longest run ``[a, b)`` of at least ``least`` words with at most one in eight missing, or None."""
    n = len(there)
    wrong = [0]
    for x in there:
        wrong.append(wrong[-1] + (not x))
    for size in range(n, least - 1, -1):
        for a in range(n - size + 1):
            if there[a] and there[a + size - 1] and (wrong[a + size] - wrong[a]) * WRONG_SHARE <= size:
                return a, a + size
    return None


Line = list[tuple[int, int, int]]  # (word, start, end) in order


def run_of(line: Line, least: int) -> tuple[int, int, int] | None:
    """``(words, start, end)`` of the longest run of a line that counts, or None."""
    if len(line) * WRONG_SHARE < least * (WRONG_SHARE - 1):
        return None
    low = line[0][0]
    there = [False] * (line[-1][0] - low + 1)
    place = {}
    for j, a, b in line:
        there[j - low] = True
        place[j - low] = a, b
    run = longest(there, least)
    return (run[1] - run[0], place[run[0]][0], place[run[1] - 1][1]) if run else None


def best_chain(item: Item, text: str, low: int, high: int) -> Line:
    """The chain with the most words over all their places in a part of a text.

    A word follows the one before it at once, or stands where a probe of the next words fits; there it may also follow a jump over at
    most an eighth of the item's words, if the gap is no longer than the words left out may be.  These are then looked for in the gap, and
    the ends of the chain are walked on.
    """
    words, ends, n = item.words, item.ends, len(item.words)
    ahead = max(LOOKAHEAD, n // WRONG_SHARE)
    best: list[dict[int, tuple[int, int, int]]] = []  # by word: start -> (length of the chain, word before, its start)
    for j, w in enumerate(words):
        own: dict[int, tuple[int, int, int]] = {}
        for start, (size, _, _) in best[j - 1].items() if j else ():
            stop = start + len(words[j - 1])
            if text.startswith(w, stop, high):
                own[stop] = size + 1, j - 1, start
        probe = item.ahead[j]
        at = text.find(probe, low, high) if len(probe) >= 3 else -1
        while at >= 0:
            top = own.get(at, (1, -1, -1))
            for s in range(1, min(ahead, j - 1) + 1):
                i = j - s - 1
                room = ends[j - 1] - ends[i] + s * item.slack
                for start, (size, _, _) in best[i].items():
                    if 0 <= at - start - len(words[i]) <= room and size + 1 > top[0]:
                        top = size + 1, i, start
            own[at] = top
            at = text.find(probe, at + 1, high)
        best.append(own)
    ends_at = [(v[0], j, p) for j, own in enumerate(best) for p, v in own.items()]
    if not ends_at:
        return []
    _, j, p = max(ends_at)
    line: Line = []
    while j >= 0:
        line.append((j, p, p + len(words[j])))
        _, j, p = best[j][p]
    line.reverse()
    whole: Line = aligned(item, text, line[0][0] - 1, line[0][1], False)[::-1]
    for k, a, b in line:
        if whole and k > whole[-1][0] + 1:
            at = whole[-1][2]
            for i in range(whole[-1][0] + 1, k):
                r = text.find(words[i], at, a)
                if r >= 0:
                    at = r + len(words[i])
                    whole.append((i, r, at))
        whole.append((k, a, b))
    return whole + aligned(item, text, line[-1][0] + 1, line[-1][2], True)


def in_order(patterns: list[int]) -> int:
    """How many different patterns stand in the item's order: the longest rising subsequence."""
    tops: list[int] = []
    for i in patterns:
        k = bisect.bisect_left(tops, i)
        tops[k : k + 1] = [i]
    return len(tops)


def chained_runs(item: Item, text: str, hits: list[tuple[int, int]], least: int) -> tuple[int, int, int] | None:
    """The longest run that counts in any part of the text with hits enough; parts are twice as long as the item can stretch."""
    reach = item.ends[-1] + (len(item.words) // WRONG_SHARE + 1) * (item.slack + 8)
    hits, found, k = sorted(hits), None, 0
    while k < len(hits):
        first = hits[k][0]
        own = [i for p, i in hits[k:] if p <= first + 2 * reach]
        if in_order(own) >= item.hits:
            run = run_of(best_chain(item, text, max(0, first - reach), first + 3 * reach) or [(0, 0, 0)], least)
            found = max(filter(None, (found, run)), default=None)
        while k < len(hits) and hits[k][0] <= first + reach:
            k += 1
    return found


def cases(text: str, items: list[Item], automaton) -> Iterator[tuple[int, int, int, int]]:
    """``(item index, words, start, end)`` of each item that leaks into a text; positions are those of ``flat(text)``."""
    plain = flat(text)
    by_item: dict[int, list[tuple[int, int]]] = {}
    for last, (length, places) in automaton.iter(plain):
        for k, i in places:
            by_item.setdefault(k, []).append((last + 1 - length, i))
    for k, hits in by_item.items():
        item, found = items[k], None
        if len(hits) < item.hits or len({i for _, i in hits}) < item.hits:
            continue  # fewer than any stretch that counts must have
        words, least, seen = item.words, max(1, -(-len(item.words) // LEAST_SHARE)), set()
        for start, i in hits:
            if (i, start) in seen:
                continue  # aligned already
            here, at = [], start
            for j in range(i, i + item.run):
                here.append((j, at, at + len(words[j])))
                at += len(words[j])
            line = aligned(item, plain, i - 1, start, False)[::-1] + here + aligned(item, plain, i + item.run, at, True)
            seen.update((j, a) for j, a, _ in line)
            run = run_of(line, least)
            if run and (found is None or run[0] > found[0]):
                found = run
        found = found or chained_runs(item, plain, hits, least)
        if found:
            yield k, *found


@lru_cache(maxsize=4)
def built(items: tuple[Item, ...]):
    return automaton_of(list(items))


def item_blocks(items: DataFrame, number: str, text: str, lang: str) -> list[list[Item]]:
    """The query set in blocks of bounded text; read in order of its number."""
    blocks, size = [[]], 0
    for row in items.select(number, text, lang).where(F.col(text).isNotNull()).orderBy(number).toLocalIterator():
        if size + len(row[1]) > BLOCK_CHARS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(item_of(row[0], row[1], row[2]))
        size += len(row[1])
    return blocks


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", number: str = "item_no", lang: str = "lang") -> DataFrame:
    """``(doc_key, number, n_words, n_item_words, start_pos, end_pos)`` of every leaked item, with positions in the original text."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[doc_key].dataType.simpleString(), items.schema[number].dataType.simpleString()
    schema = f"{doc_key} {kind}, {number} {item_kind}, n_words int, n_item_words int, start_pos int, end_pos int"
    whole = None
    for block in item_blocks(items, number, text, lang):
        shared = spark.sparkContext.broadcast(tuple(block))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = list(shared.value)
            automaton = built(shared.value)
            for batch in batches:
                rows = []
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if automaton is not None else ():
                    hits = list(cases(body, own, automaton))
                    if hits:
                        at = flat_positions(body)
                        rows += [(doc, own[k].number, n, len(own[k].words), at[a], at[b - 1] + 1) for k, n, a, b in hits]
                names = [doc_key, number, "n_words", "n_item_words", "start_pos", "end_pos"]
                kinds = [batch.schema.types[0], {"bigint": pa.int64(), "int": pa.int32()}.get(item_kind, pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=names)

        part = docs.select(doc_key, text).where(F.length(text) > 0).mapInArrow(scan, schema)
        whole = part if whole is None else whole.unionByName(part)
    return whole
