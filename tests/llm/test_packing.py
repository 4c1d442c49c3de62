import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from zonewright.llm import packing, tokens

from .helpers import awkward, empty, frame, prose


def truth(texts, capacity):
    tok = Tokenizer.from_file(tokens.word_bpe_path())
    out = []
    for i, t in texts:
        ids = [*(tok.encode(t, add_special_tokens=False).ids if t else []), 0]
        for p, k in enumerate(range(0, len(ids), capacity)):
            part = ids[k : k + capacity]
            out.append((i, p, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def placed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_places(spark):
    texts = awkward() + [(100 + k, prose(k, 5 + 37 * k % 900)) for k in range(120)]
    rows = packing.pack_documents(frame(spark, texts), tokens.word_bpe_path(), capacity=512).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(truth(texts, 512), key=key)
    n, total = placed(rows, 512), sum(r.length for r in rows)
    assert n <= -(-total // 512) * 1.02 + 1


def piece_by_piece(counts, capacity):
    """The squares rule one piece at a time: how many sequences it needs."""
    n, done = [0] * (capacity + 1), 0
    for s in sorted(counts, reverse=True):
        for _ in range(counts[s]):
            change = [(1 - 2 * n[s] if g == s else 2 * (n[g - s] - n[g]) + 2, g) for g in range(s, capacity) if n[g]]
            if change:
                g = min(change)[1]
                n[g] -= 1
                g -= s
            else:
                g = capacity - s
            if g:
                n[g] += 1
            else:
                done += 1
    return done + sum(n)


def test_plan_covers_every_piece_and_is_as_tight_as_piece_by_piece():
    draw = random.Random(2)
    for scale in (3, 40, 400, 100_000):
        counts = {s: draw.randrange(scale) for s in range(1, 200)}
        plan = packing.squares_plan(counts, 200)
        got = defaultdict(int)
        for times, lengths in plan:
            assert sum(lengths) <= 200
            for s in lengths:
                got[s] += times
        assert dict(got) == {s: c for s, c in counts.items() if c}
        if scale <= 400:
            n = piece_by_piece(counts, 200)
            assert sum(t for t, _ in plan) <= 1.002 * n + 1


def test_place_follows_the_squares():
    # 6 then 4 fill one sequence; the second 6 opens one, and 3 goes where the squared counts are least
    assert sorted(sorted(x) for _, x in packing.squares_plan({6: 2, 4: 1, 3: 1}, 10)) == [[3, 6], [4, 6]]


def test_full_sequences_and_ids(spark):
    texts = [(1, prose(1, 3000)), (2, prose(2, 700))]
    df = packing.pack_documents(frame(spark, texts), tokens.word_bpe_path(), capacity=256, with_ids=True)
    got = packing.sequences(df).collect()
    assert sum(r.n_tokens for r in got) == sum(x[3] for x in truth(texts, 256))
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)


def test_empty_table(spark):
    assert packing.pack_documents(empty(spark), tokens.word_bpe_path()).count() == 0


def test_encoder_equals_the_library():
    enc = tokens.Encoder(tokens.word_bpe_path())
    tok = Tokenizer.from_file(tokens.word_bpe_path())
    odd = ["It's 12ab ²x ¼", "Σ ΑΣ İx ß ẞ", "é combining é", "soft­hyphen", "<|endoftext|> <|x|>", "a b c \x1f d", "tabs\tand\nlines\r\n", "'ll'd X'RE", "😀 x😀y"]
    for t in odd + [prose(3, 400)]:
        want = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == want
