"""Repeated line runs against a brute-force search of all runs."""

from __future__ import annotations

import random
import re

import pytest

from raterlake.llm import line_dedup
from raterlake.llm.common import Scratch

from . import data

LAST = (1 << 63) - 1


def sequences(rows):
    """The lines with a word of each text, in order of doc_id."""
    seqs = {}
    for doc, text, *_ in rows:
        if text is not None:
            seqs[(LAST if doc is None else doc, text)] = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {k: seqs[k] for k in sorted(seqs, key=lambda k: k[0])}


def longest_earlier(seqs):
    """(key, place) of every suffix to the longest run from there on that also starts
    earlier, and where it does first."""
    places = [(k, i) for k, lines in seqs.items() for i in range(len(lines))]
    by_line = {}
    out = {}
    for k, i in places:
        best = (0, None)
        for b, j in by_line.setdefault(seqs[k][i], []):
            n = 0
            while i + n < len(seqs[k]) and j + n < len(seqs[b]) and seqs[k][i + n] == seqs[b][j + n]:
                n += 1
            if n > best[0]:
                best = (n, (b, j))
        by_line[seqs[k][i]].append((k, i))
        if best[0]:
            out[(k, i)] = best
    return out


def brute(rows, min_lines, min_words):
    """How many lines each text has, and how many lie in a run that also starts earlier and
    has min_lines lines and min_words words."""
    seqs, gone = sequences(rows), {}
    for (k, i), (n, _) in longest_earlier(seqs).items():
        if n >= min_lines and sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in seqs[k][i : i + n]) >= min_words:
            gone.setdefault(k, set()).update(range(i, i + n))
    return {k: (len(v), len(gone.get(k, ()))) for k, v in seqs.items()}


def corpus(seed, n=50):
    rng = random.Random(seed)
    pool = [data.sentence(rng, rng.randint(1, 9)) for _ in range(25)] + [data.sentence(rng, 55) for _ in range(3)]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.6 else data.sentence(rng, 4) for _ in range(rng.randint(0, 20))]
        if rows and rng.random() < 0.5:
            other = rng.choice(rows)[1].split("\n")
            a = rng.randrange(len(other))
            lines += other[a : a + rng.randint(1, 12)]
        if rng.random() < 0.3:
            lines.insert(rng.randint(0, len(lines)), "  ")
        rows.append((i, "\n".join(lines), "en", "a", 1))
    return rows


@pytest.mark.parametrize("seed, min_lines, min_words", [(1, 1, 5), (2, 3, 1), (3, 1, 1), (4, 2, 12)])
def test_equals_brute_force(spark, seed, min_lines, min_words):
    rows = corpus(seed)
    want = brute(rows, min_lines, min_words)
    got = {(r.whole.doc_id, r.whole.text): (r.n_lines, r.n_removed) for r in line_dedup.marked(data.frame(spark, rows), min_lines, min_words).collect()}
    assert got == want and sum(n for _, n in want.values()) > 20


def test_kept_text_and_first_copies(spark):
    a, b, c = "one line", "two line", "three line"
    rows = [(2, f"{b}\n\n{c}\n{b}\nend", "en", "a", 99), (1, f"{a}\n{b}\n{c}\n{b}", "en", "a", 99), (3, f"{b}\n{c}\n{b}", "en", "a", 99), (4, f"x\n{b}", "en", "a", 99)]
    out = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.remove_repeated_lines(data.frame(spark, rows)).collect()}
    assert out == {1: (rows[1][1], 99), 2: ("\nend", 4), 4: (f"x\n{b}", 99)}


def test_lone_lines_go_but_for_those_of_few_words(spark):
    foot, short = "all rights of this text are kept", "a heading"
    rows = [(i, f"{short}\nown words of number {i} and no other\n{foot}", "en", "a", 1) for i in range(5)]
    out = {r.doc_id: r.text for r in line_dedup.remove_repeated_lines(data.frame(spark, rows)).collect()}
    assert out[0] == rows[0][1] and all(out[i] == rows[i][1].removesuffix("\n" + foot) for i in range(1, 5))


def test_a_line_that_repeats_itself(spark):
    rows = [(1, "\n".join(["same line"] * 7), "en", "a", 1), (2, "\n".join(["same line"] * 3), "en", "a", 1)]
    got = {r.whole.doc_id: r.n_removed for r in line_dedup.marked(data.frame(spark, rows)).collect()}
    assert got == {k[0]: v[1] for k, v in brute(rows, 1, 5).items()} == {1: 6, 2: 3}


def test_defined_results(spark):
    df = data.frame(spark, data.awkward(), clash=True)
    out = line_dedup.marked(df)
    assert out.count() == df.count()
    by = {}
    for r in out.collect():
        by.setdefault((r.whole.doc_id, r.whole.text), set()).add((r.n_lines, r.n_removed, r.kept_text))
    assert by[(1, None)] == {(0, 0, None)} and by[(2, "")] == {(0, 0, "")} and by[(3, " \n\t ")] == {(0, 0, " \n\t ")}
    long = next(k for k in by if k[0] == 8)
    assert by[long] == {(4001, 4000, "more words here")}
    kept = line_dedup.remove_repeated_lines(df)
    assert kept.columns == df.columns and kept.count() == df.count()
    assert line_dedup.remove_repeated_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [9, 10])
def test_intervals_are_the_longest_runs(spark, seed):
    """Each suffix is a later member of the one interval of its longest earlier run, and the
    interval is named by the first suffix of all that share it."""
    rows = corpus(seed, 30)
    scratch = Scratch(spark)
    ranks = line_dedup.suffix_ranks(data.frame(spark, rows), scratch)
    got = {(r.doc, r.pos): (r.n, (r.first_doc, r.first_pos)) for r in line_dedup.intervals(ranks, scratch).collect()}
    scratch.drop()
    want = {(k[0], i): (n, (b[0], j)) for (k, i), (n, (b, j)) in longest_earlier(sequences(rows)).items()}
    assert got == want and max(n for n, _ in want.values()) > 4 and len({n for n, _ in want.values()}) > 4


def test_ranks_order_suffixes(spark):
    """Equal runs of 2^m lines share their rank and different ones don't, and the ranks of
    longer runs keep the order of the shorter ones."""
    rows = corpus(9, 20)
    scratch = Scratch(spark)
    ranks = [{(r.doc, r.pos): r.rank for r in t.collect()} for t in line_dedup.suffix_ranks(data.frame(spark, rows), scratch)]
    scratch.drop()
    seq = {k[0]: v for k, v in sequences(rows).items()}
    assert len(ranks) > 2
    for m, found in enumerate(ranks):
        n, by_run = 1 << m, {}
        for doc, lines in seq.items():
            for i in range(len(lines) - n + 1):
                by_run.setdefault(tuple(lines[i : i + n]), []).append((doc, i))
        shared = {run: places for run, places in by_run.items() if len(places) > 1}
        assert set(found) == {p for places in shared.values() for p in places}
        assert all(len({found[p] for p in places}) == 1 for places in shared.values()) and len(set(found.values())) == len(shared)
        if m:
            order = sorted(found, key=found.get)
            assert [ranks[m - 1][p] for p in order] == sorted(ranks[m - 1][p] for p in order)


def test_last_round_makes_no_join(spark, monkeypatch):
    """The round in which no pair is shared ends the race without a join."""
    text = "\n".join(f"a line of five words {i}" for i in range(40))
    frame = data.frame(spark, [(1, text, "en", "web", len(text)), (2, text, "en", "web", len(text))])
    written, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df: written.append(df.columns) or table(self, df))
    ranks = line_dedup.suffix_ranks(frame, scratch := Scratch(spark))
    assert len(ranks) == 6 and len(written) == 2 * len(ranks) + 1
    assert {(r.doc, r.pos): r.n for r in line_dedup.intervals(ranks, scratch).collect()} == {(2, i): 40 - i for i in range(40)}
    scratch.drop()
