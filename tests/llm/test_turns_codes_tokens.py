"""Conversation repair, vector codes and byte-level BPE against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tallymark.llm import bpe, conversation_repair, vector_codes

BLANKS = " \t\n\x0b\x0c\r"
TURNS = "conv_id long, turn long, role string, text string, seg long, kinds string, audit string, n int"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def plain_report(rows):
    """Every edit of every row and up to two inserts in each gap are tried."""
    rows = plain_damage(rows)
    faults, seen = [], set()
    for _, _, role, text in rows:
        solid = text.strip(BLANKS)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    found = []
    gap = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    edits = [[("D", None)] if f in ("blank", "duplicate") else [("D", None), ("K", None), ("R", "user"), ("R", "assistant")] for f in faults]
    for inserted in itertools.product(gap, repeat=len(rows) + 1):
        for chosen in itertools.product(*edits):
            cost, audit, made = 0, "", []
            for k in range(len(rows) + 1):
                for role in inserted[k]:
                    cost, audit = cost + 2, audit + "I"
                    made.append((role, ""))
                if k < len(rows):
                    e, to = chosen[k]
                    cost += {"D": 3, "K": 0, "R": 2}[e] + (e != "D" and faults[k] == "truncated")
                    audit += e
                    if e != "D":
                        made.append((to or rows[k][2], rows[k][3]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in made)):
                found.append((cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()))
    best = min(found)
    assert len({f for f in found if f[:2] == best[:2]}) == 1
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *best)


def turns():
    r = random.Random(5)
    out = []
    for conv in [*range(90), None]:
        n = r.randint(0, 3) or 1
        for k in range(n):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = r.choice(["Yes.", "No?", "cut off", "  ", "", None, "a\nb! \n", "é.", "x" * 3000 + "."])
            out.append((conv, r.choice([k, k, k, 7, None]), role, text))
    return out


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_against_all_edits(spark):
    rows = turns()
    df = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], TURNS).repartition(3)
    got = {r.conv_id: tuple(r[c] for c in FIELDS) for r in conversation_repair.repair(df).report.collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert got == {c: plain_report(v) for c, v in by.items()}


def test_repair_of_long_conversations_in_segments(spark):
    """One conversation with most rows, repeated rows, and segments of a few rows give what one segment gives."""
    r = random.Random(8)
    rows = [(1, k // 3, r.choice(["user", "assistant", "user", "assistant", "tool"]), r.choice(["Yes.", "No", f"{k}."])) for k in range(400)]
    rows += [(2, None, "user", "Hi.")] * 90 + [(None, 0, "system", "Be."), (None, 1, "user", "Go."), (None, 3, "assistant", "Ok.")]
    df = spark.createDataFrame([(*x, 1, "x", "y", 2) for x in rows], TURNS).repartition(4)
    whole = sorted(conversation_repair.repair(df, segment=10000).report.collect(), key=repr)
    for segment, fan in ((1, 2), (7, 3), (50, 64)):
        cut = conversation_repair.repair(df, segment=segment, fan=fan)
        assert sorted(cut.report.collect(), key=repr) == whole
    for conv, made in itertools.groupby(sorted(cut.turns.collect(), key=lambda t: (t.conv_id is None, t.conv_id or 0, t.seg, t.place)), key=lambda t: t.conv_id):
        made = list(made)
        want = next(x for x in whole if x.conv_id == conv)
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in made).encode()).hexdigest() == want.repaired_sha256
        assert "".join(t.edit for t in made) == want.audit.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in made))


def test_repair_cuts_segments_by_bytes(spark):
    df = spark.createDataFrame([(1, k, "user" if k % 2 else "assistant", "é" * 500 + f"{k}.") for k in range(60)], "conv_id long, turn long, role string, text string")
    a, b = (conversation_repair.repair(df, segment_bytes=n).report.collect() for n in (1 << 20, 900))
    assert a == b


def test_repair_of_nothing(spark):
    r = conversation_repair.repair(spark.createDataFrame([], TURNS))
    assert r.report.collect() == [] and r.turns.collect() == []
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    (row,) = conversation_repair.repair(spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).report.collect()
    assert tuple(row[c] for c in FIELDS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


VECTORS = "vec_id long, embedding array<{}>, label string, block string, dims int, ids string, width string, code string, error int"


def plain_codes(rows):
    """(vec_id, code, error, label_error, digest) of vectors of one length by loops over Python integers."""
    kept = [(i, [int(np.floor(4096 * np.float64(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // 8
    cut = lambda v, p: v[p * d : (p + 1) * d]
    books = [[cut(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(6):
        for p in range(8):
            own = [near(p, cut(v, p))[1] for _, v, _ in kept]
            for k in range(len(books[p])):
                of = [cut(v, p) for (_, v, _), o in zip(kept, own) if o == k]
                if of:
                    books[p][k] = [sum(c) // len(of) for c in zip(*of)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [(i, label, [near(p, cut(v, p)) for p in range(8)]) for i, v, label in kept]
    errors = {}
    for _, label, n in found:
        errors[label] = errors.get(label, 0) + sum(x for x, _ in n)
    return sorted((repr(i), "".join(f"{k:02x}" for _, k in n), sum(x for x, _ in n), errors[label], digest) for i, label, n in found)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vector_codes(spark, kind):
    r = random.Random(3)
    vectors = [[float(np.float32(r.gauss(0, 0.3))) for _ in range(16)] for _ in range(150)]
    vectors += [vectors[0]] * 20 + [None, [float("nan")] * 16, [None] + [0.0] * 15, [float("inf")] + [0.0] * 15, [0.0] * 16, [-3.0] * 16]
    rows = [(i if i % 50 else None if i else 0, v, ["a", "b", None][i % 3]) for i, v in enumerate(vectors)] + [(5, vectors[7], "a"), (5, vectors[5], "b")]
    df = spark.createDataFrame([(*x, "z", 1, "y", "w", "c", 2) for x in rows], VECTORS.format(kind)).repartition(7)
    for block in (4096, 11):
        got = vector_codes.vector_codes(df, block=block).collect()
        assert sorted((repr(x.vec_id), x.code, x.error, x.label_error, x.codebooks_sha256) for x in got) == plain_codes(rows)


def test_vector_codes_of_other_lengths_and_few_vectors(spark):
    rows = [(k, [k / 7] * 8, None) for k in range(5)] + [(9, [1.0, 2.0, 3.0] * 3, "a"), (8, [], "a"), (7, [0.5] * 24, "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)
    got = {x.vec_id: x for x in vector_codes.vector_codes(df).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 7, 8, 9] and all(len(x.code) == 16 for x in got.values())
    assert [x[1:] for x in plain_codes(rows[:5])] == [(got[k].code, got[k].error, got[k].label_error, got[k].codebooks_sha256) for k in range(5)]
    assert vector_codes.vector_codes(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="too large"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e30] * 8, "a")], "vec_id long, embedding array<double>, label string"))


SIGNS = ["a", "ab", "the", "é", "漢字", "。", "1", " ", "\n", "  ", "'s", "'ll", "'", "''", "<|endoftext|>", "<|end", "oftext|>", "😀", "-", "\x1c", "　", "x" * 40, " " * 17, "\n" * 9, "7" * 21, "." * 30, "\x85", "ſ", "²"]


def many_texts():
    r = random.Random(11)
    out = []
    for _ in range(300):
        pick = r.sample(SIGNS, r.randint(1, 6))
        out.append("".join(r.choice(pick) for _ in range(r.randint(0, 300))))
        out.append("".join(chr(r.choice([r.randrange(97, 123), r.randrange(97, 123), r.randrange(0x4E00, 0x4F00)])) for _ in range(r.randint(1, 700))))
    return out + ["", " ", "a" * 5000, "漢" * 3000, "=" * 2999 + "'s", "word " * 1000, "\n" * 4000 + "x", "q7" * 2000]


def test_bpe_joins_agree_with_the_library():
    v = bpe.Vocabulary.load(bpe.VOCABULARY_PATH)
    for k, t in enumerate(many_texts()):
        want = v.tok.encode(t, add_special_tokens=False).ids
        assert next(v.ids([t])) == want
        level = [v.whole(x) for x in bpe._halves(t, (3, 17, 64, 200)[k % 4])]
        while len(level) > 1:
            level = [v.join(*level[i : i + 2]) for i in range(0, len(level), 2)]
        assert level[0][0].tolist() == want and np.array_equal(level[0][1], v.whole(t)[1])
        assert v.decode(want).decode() == v.tok.decode(want, skip_special_tokens=False) == t


def test_bpe_decodes_any_ids():
    v, r = bpe.Vocabulary.load(bpe.VOCABULARY_PATH), random.Random(2)
    for _ in range(500):
        ids = [r.randrange(0, 50300) for _ in range(r.randint(0, 30))]
        assert v.decode(ids).decode() == v.tok.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("leaf, fan", [(50, 2), (300, 8), (1 << 15, 8)])
def test_bpe_of_a_table(spark, leaf, fan):
    tok = bpe.Vocabulary.load(bpe.VOCABULARY_PATH).tok
    texts = [*many_texts()[-60:], None, "<|endoftext|>" * 90, "ab " * 30000]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(1, texts[1])] * 3
    df = spark.createDataFrame([(*x, 1, 2, "z", "y", "w") for x in rows], "doc_id long, text string, row int, node int, piece string, ids string, starts string").repartition(5)
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((repr(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.encode(df, leaf=leaf, fan=fan, digest=True).collect()
    assert sorted((repr(x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got) == sorted(want)
    back = bpe.decode(bpe.encode(df, leaf=leaf, fan=fan)).collect()
    assert sorted((repr(x.doc_id), x.text) for x in back) == sorted((repr(i), t or "") for i, t in rows)
    assert bpe.encode(df.limit(0), leaf=leaf).collect() == []
