"""Operator 12 against a plain version of its contract."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corvida.llm import alignment
from corvida.llm.tokens import vocabulary

SCHEMA = "doc_id long, text string, row string, at long, side int, size double, pair string, n long"


def sides():
    a, b = Tokenizer.from_file(vocabulary()), sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    def one(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(letters[c] for c in a.id_to_token(i)) for i in ids]
    def other(text):
        ids = b.encode(text)
        return ids, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
    return one, other


def aligned(rows):
    """What the contract says, token by token."""
    one, other = sides()
    out, links = [], []
    for doc_id, text in rows:
        (a, ra), (b, rb) = (one(text), other(text)) if text else (([], []), ([], []))
        if not text or b"".join(ra) != (" " + text).encode() or b"".join(rb) != (" " + text).encode():
            out.append([doc_id, 0, 0, 0, 0, ""])
            links.append([])
            continue
        def ends(raw):
            n, found = 0, []
            for x in raw:
                n += len(x)
                found.append(n)
            return found
        ea, eb = ends(ra), ends(rb)
        groups, i, j, mine = [], 0, 0, []
        for end in sorted(set(ea) & set(eb)):
            ga, gb = [], []
            while i < len(ea) and ea[i] <= end:
                ga.append(a[i])
                i += 1
            while j < len(eb) and eb[j] <= end:
                gb.append(b[j])
                j += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        at = 0
        for k, (x, end) in enumerate(zip(a, ea)):
            begin = end - len(ra[k])
            while eb[at] <= begin:
                at += 1
            m = at
            while m < len(eb) and eb[m] - len(rb[m]) < end:
                mine.append((x, b[m]))
                m += 1
        out.append([doc_id, len(a), len(b), len(groups), len(mine), ";".join(groups)])
        links.append(mine)
    count = Counter(x for mine in links for x in mine)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    return [(*head[:5], sum(count[x] == best[x[1]] for x in mine), sum(count[x] for x in mine), hashlib.sha256(head[5].encode()).hexdigest() if head[5] else "") for head, mine in zip(out, links)], out, links


def texts():
    rng = random.Random(3)
    vocab = ["the", "cat", "running", "Straße", "naïve", "中文", "don't", "x1y2", "internationalisation", "🙂🙂", "½", "1234567"]
    out = [None, "", " ", "  ", "\n", "a", " a", "a  b \t c\r\n d", "<|endoftext|> y <s> z </s> <0x41> <unk>", "U+2581 ▁ here", "nul \x00 inside", "non breaking space \u0085 　wide", "x" * 9000, "🙂" * 3000, " lead and trail  "]
    out += [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    out += ["same text again and again"] * 5 + [" ".join(rng.choice(vocab) for _ in range(9000))]
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def key(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


@pytest.fixture(scope="module")
def rows():
    return [(None if i % 11 == 5 else 9007199254740993 + i, t) for i, t in enumerate(texts())]


@pytest.mark.parametrize("common", [1_000_000, 20, 0])
def test_brute_force(spark, rows, common):
    docs = spark.createDataFrame([(i, t, "r", 1, 2, 0.5, "p", 3) for i, t in rows], SCHEMA).repartition(3)
    got = [tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, common=common).collect()]
    assert sorted(got, key=key) == sorted(aligned(rows)[0], key=key)


def regular(n, a, b):
    """A Thue-Morse word: its turns of two letters cancel out where places count by powers."""
    out = [a]
    while len(out) < n:
        out += [b if x == a else a for x in out]
    return "".join(out)


def odd_texts():
    """Single spaces at the end, behind every kind of letter; long regular words; pieces put together at random."""
    rng = random.Random(5)
    parts = [*"  \t\n\x0b\x0c\x1c\x85\xa0\u2009\u3000\u200b\u180e\ufeffaBz1.'’é\u0301中🙂▁\x00٠½_\U0010ffff", "  ", "   ", "\r\n", "'s", "<s>", "<unk>", "<0x0A>", "<|endoftext|>", "Straße", "the"]
    out = ["a ", "é ", "中 ", "🙂 ", "word ", "two words ", "a\n ", ". ", "\x00 ", " ", ""]
    out += [regular(n, *x) for n in (512, 1024, 4096) for x in ("ab", "ba")] + [regular(2048, "x", "y") + " " + regular(2048, "y", "x")]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(400)]


def test_odd_texts_by_brute_force(spark):
    rows = list(enumerate(odd_texts()))
    got = [tuple(r[c] for c in COLUMNS) for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got) == sorted(aligned(rows)[0])


def test_machine_in_small_steps(rows):
    """The machine alone, fed row by row with a step after each: the same groups, links and hashes."""
    one, other = sides()
    want, heads, mine = aligned(rows)
    fed = []
    for row, (doc_id, text) in enumerate(rows):
        full = (" " + (text or "")).encode()
        for side, encode in enumerate((one, other)):
            ids, raw = encode(text) if text else ([], [])
            if not text or b"".join(raw) != full:
                fed.append((row, 0, side, doc_id, False, 0, b""))
                continue
            at = 0
            for s in range(0, len(ids), 37):
                fed.append((row, at, side, doc_id, True, len(full), np.array(ids[s : s + 37], np.uint16).tobytes()))
                at += sum(map(len, raw[s : s + 37]))
    fed.sort(key=lambda x: x[:3])
    machine = alignment.Sweep(tuple(alignment._side(*x).width for x in ((alignment.ByteSide, vocabulary()), (alignment.PieceSide, vocabulary("piece_bpe_32k.model")))), True)
    out = []
    for x in fed:
        batch = pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(x, alignment._EVENTS)], schema=alignment._EVENTS)
        out += list(machine.add(batch))
        if machine.row:
            out.append(machine.step())
    out += list(machine.finish())
    table = pa.Table.from_batches(out).to_pylist()
    found = {}
    for r in table:
        head = found.setdefault(r["row"], [r["doc_id"], 0, 0, 0, 0, None, []])
        for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links")):
            head[k + 1] += r[c]
        head[5] = r["groups_sha256"] if r["groups_sha256"] is not None else head[5]
        head[6] += [r["groups"]] if r["groups"] else []
    assert len(table) > len(rows)  # some documents came in parts
    assert [tuple(found[i][:5]) for i in range(len(rows))] == [tuple(x[:5]) for x in want]
    assert [found[i][5] for i in range(len(rows))] == [x[7] for x in want]
    assert [";".join(found[i][6]) for i in range(len(rows))] == [h[5] for h in heads]


def test_links(spark):
    rows = [(1, "running cats"), (2, None), (3, "internationalisation of naïve 中文")]
    _, heads, mine = aligned(rows)
    got = {r["doc_id"]: r for r in alignment.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, _), head, links in zip(rows, heads, mine):
        assert got[i]["groups"] == head[5]
        assert Counter({(x["a"], x["b"]): x["times"] for x in got[i]["links"]}) == Counter(links)


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA)).count() == 0
