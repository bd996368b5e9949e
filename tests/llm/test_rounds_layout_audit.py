"""The operators of merge rounds, layout and filter audit against brute-force versions."""

import hashlib
import json
import random
import re
import struct
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from lorekeep.llm import bpe_rounds, interactions, layout

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, z string, file int, part string, mask int, ids binary, n int"


def rows_of(spark, rows):
    """Documents (doc_id, text, lang, source) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 0, "z", 1, "p", 7, b"x", 3) for r in rows], SCHEMA)


# merge rounds

def test_rounds_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    texts = [
        None, "", " ", "a", "hello <|endoftext|> there", "<|endoftext|><|endoftext|>x  <|endoftext|>  y", "x<|endoftext|", "word<|endoftext|>word", "don't we'll I'M",
        "a" * 1001, "ab" * 70_000, "é" * 333 + " " * 100 + "\n\n x", "newer letters ՘a \U00010940 b", "same text", "same text", "plain words, " * 20_000,
    ]
    for _ in range(400):
        texts.append("".join(rng.choice("abcdeéñ 123\n\t.,!<|>endoftx'sтест中文🙂 \u0085\x1c") for _ in range(rng.randint(1, 200))))
        texts.append("".join(chr(rng.choice([rng.randrange(1, 0x3000), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randint(1, 60))))
    docs = rows_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in bpe_rounds.digests(docs, path, P.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids), t
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_rounds.digests(docs.limit(0), path, P.PATTERN).count() == 0


def test_every_token_and_every_code_point():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe_rounds.Codec(path, P.PATTERN)
    tokens = [library.decode([i], skip_special_tokens=False) for i in range(library.get_vocab_size())]
    assert [x.tolist() for x in own.encode(tokens)] == [x.ids for x in library.encode_batch(tokens, add_special_tokens=False)]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["\n".join(f"a{chr(c)}1 {chr(c)}!" for c in points[k : k + 4000]) for k in range(0, len(points), 4000)]
    assert [x.tolist() for x in own.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def plain_merge(word, merges, letters):
    """One merge at a time: the lowest rank, the leftmost place."""
    own = [letters[b] for b in word]
    while True:
        found = [(merges[a, b], i) for i, (a, b) in enumerate(zip(own, own[1:], strict=False)) if (a, b) in merges]
        if not found:
            return own
        _, i = min(found)
        own[i : i + 2] = [own[i] + own[i + 1]]


def test_vocabularies_whose_products_rank_lower(tmp_path):
    rng, letters = random.Random(9), bpe_rounds.byte_letters()
    for n in range(6):
        merges, known = [], ["a", "b", "c"]
        while len(merges) < 40:
            pair = (rng.choice(known), rng.choice(known))
            if pair not in merges:
                merges.append(pair)
                known.append("".join(pair))
        rng.shuffle(merges)  # a product may now stand in a pair that comes before it
        vocab = {x: i for i, x in enumerate(dict.fromkeys([*letters, *known]))}
        file = tmp_path / f"{n}.json"
        model = {"type": "BPE", "vocab": vocab, "merges": [" ".join(m) for m in merges]}
        file.write_text(json.dumps({"model": model, "normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}))
        own, ranks = bpe_rounds.Vocabulary(str(file)), {m: i for i, m in enumerate(merges)}
        assert own.early.any()
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 30))).encode() for _ in range(300)]
        ids, counts = bpe_rounds.merge_rounds(words, own)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for word, part in zip(words, parts, strict=True):
            assert part.tolist() == [vocab[x] for x in plain_merge(word, ranks, letters)]


def test_a_forgotten_word_is_merged_again():
    path = P.path("byte_bpe_50k.json")
    small, large = bpe_rounds.Codec(path, P.PATTERN, 20, 200), bpe_rounds.Codec(path, P.PATTERN)
    rng = random.Random(2)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(50)) for _ in range(3)]
        assert [x.tolist() for x in small.encode(texts)] == [x.tolist() for x in large.encode(texts)]


# layout

def plain_layout(rows, file_rows):
    own = []
    for doc_id, text, lang, source in rows:
        text_id = "" if doc_id is None else str(doc_id)
        own.append({"doc_id": doc_id, "source": source, "lang": lang, "length": -1 if text is None else len(text.encode()), "date": zlib.crc32(text_id.encode()) % 365})
    low = lambda v: (0, b"") if v is None else (1, v.encode()) if isinstance(v, str) else (1, v)
    for c in layout.VALUES:
        all_ = sorted(low(r[c]) for r in own)
        first = {}
        for i, v in enumerate(all_):
            first.setdefault(v, i)
        for r in own:
            r[f"at_{c}"] = 16 * first[low(r[c])] // len(own)
    for r in own:
        digits = "".join(format(r[f"at_{c}"], "04b")[k] for k in range(4) for c in ("length", "source", "date", "lang"))
        r["z"] = int(digits, 2)
    own.sort(key=lambda r: (r["z"], r["doc_id"] is not None, r["doc_id"] or 0))
    for i, r in enumerate(own):
        r["position"], r["file"] = i, i // file_rows
    boxes = {}
    for r in own:
        for c in layout.VALUES:
            a, b = boxes.setdefault(r["file"], {}).get(c, (99, -1))
            boxes[r["file"]][c] = (min(a, r[f"at_{c}"]), max(b, r[f"at_{c}"]))
    for r in own:
        box = {c: (r[f"at_{c}"] - w, r[f"at_{c}"] + w) for c, w in (("source", 0), ("lang", 0), ("length", 2), ("date", 2))}
        r["files_touched"] = sum(all(b[c][0] <= box[c][1] and b[c][1] >= box[c][0] for c in box) for b in boxes.values())
        r["files_matching"] = len({x["file"] for x in own if all(box[c][0] <= x[f"at_{c}"] <= box[c][1] for c in box)})
        r["file_bounds"] = ",".join(f"{boxes[r['file']][c][0]},{boxes[r['file']][c][1]}" for c in layout.VALUES)
    return [tuple(r[c] for c in ("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")) for r in own]


@pytest.mark.parametrize("file_rows", [1, 7, 500])
def test_layout(spark, file_rows):
    rng = random.Random(file_rows)
    rows = []
    for i in range(420):
        source = rng.choice([None, "", "hot", "hot", "hot", "é", "z", "\U00010000", "￿", f"s{rng.randint(0, 30)}"])
        lang = rng.choice([None, "en", "en", "fr", "de", ""])
        text = rng.choice([None, "", "x" * rng.randint(0, 40), "é" * rng.randint(0, 40), "one text"])
        rows.append((i * 3 - 50, text, lang, source))
    rows += [(9001, "x" * 2_000_000, "en", "hot"), (None, "no id", "en", "hot"), rows[5], rows[5]]
    got = layout.clustered(rows_of(spark, rows), file_rows=file_rows)
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"]
    key = lambda r: (r[2], str(r[0]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_layout(rows, file_rows), key=key)


def test_layout_of_few_rows(spark):
    assert layout.clustered(rows_of(spark, [])).count() == 0
    assert layout.clustered(rows_of(spark, [(None, None, None, None)])).collect()[0][1:] == (0, 0, 0, 1, 1, "0,0,0,0,0,0,0,0")
    same = [(i, "t", "en", "s") for i in range(5)]
    assert sorted(map(tuple, layout.clustered(rows_of(spark, same), file_rows=2).collect())) == sorted(plain_layout(same, 2))


# filter audit

def plain_audit(rows, labels):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    parts = {}
    for doc_id, text, lang, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None, "E": doc_id is not None and first[text] < doc_id,
        }
        parts.setdefault(lang or "", []).append(({f for f in fails if fails[f]}, doc_id in good, doc_id in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                kept = [d for d in left if f not in d[0]]
                failing = [d for d in docs if f in d[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(kept), len(gone), len(failing) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                left = kept
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark):
    rng = random.Random(3)
    texts = [None, "", "copy " * 210, "Copy " * 210, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)), "#tag " + " ".join(f"v{i}" for i in range(205)), "short\x0b\x0ctext", " nbsp  em"]
    rows = [(i * 7 % 211, rng.choice(texts) if rng.random() < 0.7 else " ".join(rng.choice("abcdefgHIJ$") * rng.randint(1, 3) for _ in range(rng.randint(0, 260))), rng.choice(["en", "en", "fr", None, ""]), "s") for i in range(211)]
    rows += [rows[3], rows[3], (rows[3][0], rows[3][1], "fr", "s"), (None, "copy " * 210, "en", "s"), (None, None, None, None), (5000, "long " * 300_000, "en", "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    said = spark.createDataFrame([(*x, "en") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = interactions.audit(rows_of(spark, rows), said)
    assert dict(got.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "bigint")
    found = {(r[0], r[1], r[2]): tuple(r[3:]) for r in got.collect()}
    want = plain_audit(rows, labels)
    assert len(found) == len(want) == 3 * 600 and found == want
    assert interactions.audit(rows_of(spark, []), said).count() == 0
