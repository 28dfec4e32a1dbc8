"""Operators on documents against brute force, on cases that are odd in every column."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docsift.llm import byte_bpe, shards
from docsift.llm.best_fit import pack_documents, pack_lengths, plan_rows
from docsift.llm.bk_tree import linked_groups
from docsift.llm.compression_rules import Bands, judge_documents, keep_good, verdict
from docsift.llm.secret_scan import MASK, RULES, Scanner, needs_full_scan, redact_documents, scan_documents
from docsift.llm.simhash_dedup import keep_one_of_each, near_duplicates
from docsift.llm.simple8b import pack, unpack, unpack_block
from docsift.llm.substring_dedup import COVER, PERIOD, WINDOW, remove_repeated_passages, remove_repeats
from docsift.llm.token_files import documents_of, write_token_files
from docsift.llm.tokens import ByteLevelEncoder, WordEndEncoder, byte_level_encoder

SF_DIR = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, verdict string, row string, fingerprint long, n_chars long"
PROSE = " ".join(f"word{i % 97} of{i * 7 % 89} line{i * i % 83}" for i in range(60))
HEX = "0123456789abcdef" * 2
ODD_TEXTS = [
    None, "", " \n\t ", "one", "a b c", PROSE, PROSE, PROSE + " end", PROSE.upper(), "naïve café İstanbul 中文 \U0001f600",
    "a  b   c \n\n d", "tail space ", "<|endoftext|> <|startoftext|>", f'password = "{HEX}" and {HEX} AKIA{"Q7" * 9}',
    f"API_KEY:{HEX.upper()}", "x " * 400, "same line\n" * 80, PROSE + "\n" + PROSE, "word " * 3 + PROSE * 40,
    "ghp_" + "a1B2" * 10, "\x00\x1f control \x85   spaces", "it's they'LL we've 'd",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, text, "v", "r", i, None) for i, text in enumerate(ODD_TEXTS)]
    rows += [(5, PROSE, "v", "r", 5, None), (None, PROSE, "v", "r", 0, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(str(SF_DIR / "documents.parquet"))


@pytest.fixture
def tables(odd, corpus):
    return [odd, corpus, odd.limit(0)]


def texts_of(frame):
    return sorted(((r.doc_id, r.text or "") for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def rows_of(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


def test_byte_bpe_round_trip(tables):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(None, path)
    reference = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for frame in tables:
        found = byte_bpe.encode_documents(frame, path, public_tokenizers.PATTERN, 16, 3000, decoded=True)
        expected = []
        for doc_id, text in texts_of(frame):
            ids = reference.encode_ordinary(text)
            expected.append((doc_id, len(ids), np.array(ids, "<u4").tobytes(), text.encode()))
        assert rows_of(found, "doc_id", "n_tokens", F.col("ids").cast("binary"), "decoded") == sorted(
            [(a, b, bytearray(c), bytearray(d)) for a, b, c, d in expected], key=repr
        )
        decoded = found.select((byte_bpe.decode(path)(F.col("ids")) == F.col("decoded")).alias("same"))
        assert all(row.same for row in decoded.collect())


def jump(key, n):
    at, following = -1, 0
    while following < n:
        at = following
        key = (key * shards.MULTIPLIER + 1) % 2**64
        following = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_shards(spark, tables, workspace):
    for frame in tables:
        found = shards.shard_documents(frame, 8, workspace).collect()
        expected = []
        for doc_id, text in texts_of(frame):
            key = int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:16], 16)
            data = text.encode()
            expected.append((doc_id, len(data) + 1, zlib.crc32(data), "key", jump(key, 8), jump(key, 9)))
        assert sorted([(r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in found], key=repr) == sorted(
            expected, key=repr
        )
        assert all(r.grown_shard in (r.shard, 8) for r in found)
        for shard in {r.shard for r in found}:
            slots = sorted(r.slot for r in found if r.shard == shard)
            assert slots == list(range(len(slots)))
    many = spark.range(2000).select(shards.jump_shards(F.col("id"), [1, 500]).alias("s"), "id").collect()
    for row in many:
        key = int(hashlib.md5(str(row.id).encode()).hexdigest()[:16], 16)
        assert (row.s["shard_1"], row.s["shard_500"]) == (0, jump(key, 500))


def test_compression_bands(tables):
    for frame in tables:
        found = judge_documents(frame)
        expected = []
        for doc_id, text in texts_of(frame):
            w = words(text)
            windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
            covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
            lines = [line for line in text.split("\n") if words(line)]
            expected.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
                             len(lines) - len(set(lines)), len(covered),
                             len(w) < 50 or 100 * len(covered) > 50 * len(w)))
        assert rows_of(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed") == sorted(expected, key=repr)
        assert found.where("base_failed AND kept").isEmpty()
        assert keep_good(frame).columns == frame.columns
        assert keep_good(frame).count() == found.where("kept").count()


def test_clean_documents_are_kept(spark, corpus):
    labels = spark.read.parquet(str(SF_DIR / "labels.parquet"))
    good = judge_documents(corpus).join(labels, "doc_id").where("quality = 1 AND NOT base_failed")
    assert good.count() and good.where("NOT kept").isEmpty()
    noise = np.random.default_rng(1).integers(33, 127, 6000, dtype=np.uint8).tobytes().decode()
    noise = " ".join(noise[i : i + 9] for i in range(0, 6000, 9))
    dull = "".join(f"entry {i % 9} of the list, all alike. " for i in range(300))
    made = spark.createDataFrame([(1, noise), (2, dull)], "doc_id long, text string")
    assert judge_documents(made).where("kept").isEmpty()


# From the Universal Declaration of Human Rights, not used to set the limits.
DECLARATIONS = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and "
    "should act towards one another in a spirit of brotherhood. Everyone is entitled to all the rights and freedoms set forth "
    "in this Declaration, without distinction of any kind, such as race, colour, sex, language, religion, political or other "
    "opinion, national or social origin, property, birth or other status. Everyone has the right to life, liberty and "
    "security of person. No one shall be held in slavery or servitude; slavery and the slave trade shall be prohibited in "
    "all their forms. No one shall be subjected to torture or to cruel, inhuman or degrading treatment or punishment.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны "
    "поступать в отношении друг друга в духе братства. Каждый человек должен обладать всеми правами и всеми свободами, "
    "провозглашенными настоящей Декларацией, без какого бы то ни было различия, как-то в отношении расы, цвета кожи, пола, "
    "языка, религии, политических или иных убеждений, национального или социального происхождения, имущественного, "
    "сословного или иного положения. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность. "
    "Никто не должен содержаться в рабстве или в подневольном состоянии; рабство и работорговля запрещаются во всех их видах.",
}


def kept_texts(spark, texts):
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [row.kept for row in judge_documents(made).orderBy("doc_id").collect()]


def test_prose_of_other_scripts_is_kept(spark, corpus):
    labels = spark.read.parquet(str(SF_DIR / "labels.parquet"))
    good = judge_documents(corpus).join(labels, "doc_id").where("quality = 1 AND NOT base_failed")
    texts = [row.text for row in corpus.join(good.select("doc_id"), "doc_id").collect()]
    cyrillic = str.maketrans("abcdefghijklmnopqrstuvwxyz", "абцдефгхижклмнопярстуввхыз")
    assert all(kept_texts(spark, [text.lower().translate(cyrillic) for text in texts]))
    licenses = [path.read_text() for name in ("Apache-2.0", "MPL-2.0", "GPL-3")
                if (path := Path("/usr/share/common-licenses", name)).exists()]
    assert all(kept_texts(spark, [*DECLARATIONS.values(), *licenses]))


def test_hidden_noise_is_found(spark, corpus):
    rng = np.random.default_rng(4)
    labels = spark.read.parquet(str(SF_DIR / "labels.parquet")).where("quality = 1")
    good = [row.text for row in corpus.join(labels, "doc_id").orderBy("doc_id").collect() if len(words(row.text)) >= 50]
    clean = re.sub(r"[^ -~]", "", " ".join(dict.fromkeys(good)))
    clean = clean * (1 + 200_000 // len(clean))

    def noise(n):
        return base64.b64encode(rng.bytes(n)).decode()[:n]

    def spam(n):
        return ("Buy cheap watches now at our great shop, best prices! " * n)[:n]

    made = [clean[:8192] + noise(4000), clean[:4096] + noise(1200), clean[:700] + noise(400)]
    made += [clean[: n * 7 // 10] + noise(n * 3 // 10) for n in (8_000, 32_000)]
    made += [clean[:52_000] + spam(13_000), clean[:16_000] + noise(8_000) + spam(8_000)]
    found = judge_documents(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()
    assert [row.doc_id for row in found if row.kept] == []
    assert [row.doc_id for row in found if row.base_failed] in ([], [5])
    assert all(kept_texts(spark, [clean[:n] for n in (600, 1100, 4095, 8192, 12_000)]))


def test_secrets(tables):
    assert needs_full_scan() == ["hex"]
    scanner = Scanner()
    for frame in tables:
        found = {}
        for row in scan_documents(frame).collect():
            found.setdefault(row.doc_id, []).append(row)
        for doc_id, text in texts_of(frame):
            plain = sorted(
                (m.start(), number, m.end())
                for number, (rule, pattern) in enumerate(zip(RULES, scanner.patterns, strict=True))
                for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least
            )
            shown = [f"{RULES[n].kind}:{a}:{b}" for a, n, b in plain]
            base = [x for x in shown if x.split(":")[0] in ("assign", "access", "hex")]
            row = (",".join(shown), hashlib.sha256(",".join(base).encode()).hexdigest())
            assert row in [(r.spans, r.base_sha256) for r in found[doc_id]]
        masked = redact_documents(frame)
        assert masked.columns == frame.columns and masked.count() == frame.count()
        assert masked.where("text LIKE '%0123456789abcdef0123%'").isEmpty()
    assert tables[0].where("text IS NULL").count() == redact_documents(tables[0]).where("text IS NULL").count()
    assert MASK in redact_documents(tables[0]).where("doc_id = 13").first().text


def test_whole_private_keys_are_found(spark):
    body = base64.b64encode(np.random.default_rng(6).bytes(1201)).decode()
    lines = [body[i : i + 64] for i in range(0, len(body), 64)]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    headers = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF", ""]
    short = [*lines[:-1], "Ab3dE9=="]
    keys = [
        "\n".join([begin, *headers, *lines, end]), "\\n".join([begin, *lines, end, ""])[:-2], "\n".join([begin, *short, end]),
        "\\n".join([begin, *headers, *lines]), "\n".join([begin, *headers, *short]), "\r\n".join([begin, *short]), begin,
        "\n".join([begin, "\n".join(f"> {line}" for line in lines), end]),
    ]
    texts = [f"Before it {key}{after}" for key in keys for after in ("", " and after it.", "\n-----BEGIN CERTIFICATE-----")]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in scan_documents(made).collect():
        spans = [span for span in row.spans.split(",") if span.startswith("private_key:")]
        assert spans == [f"private_key:10:{10 + len(keys[row.doc_id // 3])}"], (row.doc_id, spans)
    for row in redact_documents(made).collect():
        assert row.text == "Before it " + MASK + texts[row.doc_id][10 + len(keys[row.doc_id // 3]) :]


def test_difference_cover():
    for a in range(PERIOD):
        for b in range(PERIOD):
            assert any((a + s) % PERIOD in COVER and (b + s) % PERIOD in COVER for s in range(PERIOD))


def test_repeated_passages(tables, workspace):
    for frame in tables:
        documents = [(i, words(t)) for i, t in texts_of(frame)]
        times = Counter(tuple(w[k : k + WINDOW]) for _, w in documents for k in range(len(w) - WINDOW + 1))
        expected = []
        for doc_id, w in documents:
            gone = {k + x for k in range(len(w) - WINDOW + 1) if times[tuple(w[k : k + WINDOW])] > 1 for x in range(WINDOW)}
            expected.append((doc_id, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
        found = remove_repeats(frame.select("doc_id", "text"), workspace)
        assert rows_of(found, "row.doc_id", "n_words", "n_removed", "kept") == sorted(expected, key=repr)
        cut = remove_repeated_passages(frame, workspace)
        assert cut.columns == frame.columns and cut.count() == frame.count()
        assert sorted(len(words(t)) for _, t in texts_of(cut)) == sorted(len(words(e[3])) for e in expected)


def simhash(text):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(tables, workspace):
    for frame, limit in zip(tables, (3, 20_000, 10), strict=True):
        documents = [(i, simhash(t)) for i, t in texts_of(frame)]
        component = list(range(len(documents)))
        changed = True
        while changed:
            changed = False
            for a, (_, x) in enumerate(documents):
                for b, (_, y) in enumerate(documents):
                    if (x ^ y).bit_count() <= 4 and component[a] > component[b]:
                        component[a], changed = component[b], True
        least = {}
        for (doc_id, _), c in zip(documents, component, strict=True):
            if doc_id is not None:
                least[c] = min(least.get(c, doc_id), doc_id)
        expected = [(i, x, least.get(c)) for (i, x), c in zip(documents, component, strict=True)]
        found = near_duplicates(frame, workspace, shard_limit=limit).collect()
        assert sorted([(r.doc_id, r.fingerprint % 2**64, r.component_id) for r in found], key=repr) == sorted(expected, key=repr)
        kept = keep_one_of_each(frame, workspace)
        assert kept.columns == frame.columns
        ids = [r.doc_id for r in kept.collect()]
        assert sorted(i for i in ids if i is not None) == sorted(set(least.values()))
        assert ids.count(None) == frame.where("doc_id IS NULL").count()


def test_one_doc_id_with_several_texts(spark, workspace):
    unlike = [" ".join(f"{kind}{(i * i + kind) % 101}" for i in range(60)) for kind in range(13)]
    rows = [(kind % 2, text, f"row {kind}") for kind, text in enumerate(unlike)]
    # Copies under the same and other ids, and a row repeated as a whole.
    rows += [(0, unlike[0], "again"), (7, unlike[1], "copy"), (9, unlike[2] + " end", "near"), *[(5, unlike[3], "same")] * 4]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    kept = [(row.doc_id, row.text) for row in keep_one_of_each(frame, workspace).collect()]
    marks = {text: simhash(text) for _, text, _ in rows}
    assert all((marks[a] ^ marks[b]).bit_count() > 4 for i, a in enumerate(unlike) for b in unlike[:i])
    assert sorted(kept) == sorted((kind % 2, text) for kind, text in enumerate(unlike))


def test_flag_columns_survive(spark, workspace):
    rows = [(1, PROSE, "mine", "x"), (2, PROSE, "yours", None), (3, None, None, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, text_was_null string, Text_Was_Null_0 string")
    found = remove_repeated_passages(frame, workspace).orderBy("doc_id").collect()
    assert [(r[2], r[3]) for r in found] == [r[2:] for r in rows]
    assert [words(r.text or "") for r in found] == [[], [], []] and found[2].text is None


def test_packing_plan_does_not_grow(spark):
    rng = np.random.default_rng(1)
    base = Counter(np.clip(rng.lognormal(5.5, 1, 4000), 20, 2048).astype(int).tolist())
    sizes = [
        (lambda packing, counts: (packing.steps, len(list(plan_rows(packing, counts)))))(pack_lengths(counts, 2048), counts)
        for times in (10, 10_000) for counts in [{length: n * times for length, n in base.items()}]
    ]
    assert sizes[0][0] == sizes[1][0] <= len(base) and sizes[1][1] < 1.2 * sizes[0][1]


def test_tree_groups():
    rng = np.random.default_rng(5)
    centres = [int(x) for x in rng.integers(0, 2**63, 5)]
    values = list({c ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))) for c in centres * 60})
    groups = {frozenset(g) for g in linked_groups(values, 4)}
    expected, left = set(), set(values)
    while left:
        group, waiting = set(), [left.pop()]
        while waiting:
            x = waiting.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 4}
            left -= near
            waiting += near
        if len(group) > 1:
            expected.add(frozenset(group))
    assert groups == expected


@pytest.mark.parametrize("highest", [1, 2, 300, 2**17, 2**40, 2**60, 2**64 - 1])
@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 3000])
def test_simple8b_round_trip(n, highest):
    ids = np.random.default_rng(n).integers(0, highest, n, dtype=np.uint64, endpoint=True)
    ids[::5] = 0
    data = pack(ids)
    assert (unpack(data) == ids).all()
    for block in range(-(-n // 1024)):
        assert (unpack_block(data, block) == ids[block * 1024 : block * 1024 + 1024]).all()


def test_token_files(tables, workspace):
    path = public_tokenizers.path("word_bpe_49k.json")
    reference = Tokenizer.from_file(path)
    for frame in tables:
        found = documents_of(write_token_files(frame, workspace.folder("files"), path, 2, segment_ids=500)).collect()
        lengths = {}
        for doc_id, text in texts_of(frame):
            ids = np.array([*reference.encode(text, add_special_tokens=False).ids, 2], "<u4")
            lengths.setdefault(doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
        at = 0
        for row in sorted(found, key=lambda r: r.start):
            assert row.start == at
            at += row.n_tokens
            lengths[row.doc_id].remove((row.n_tokens, row.ids_crc32))
        assert not any(lengths.values())
        order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
        assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def check_packing(rows, expected, capacity):
    sequences = {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    pieces = {}
    for row in rows:
        pieces.setdefault(row.doc_id, []).append((row.piece, row.start, row.length, row.ids_crc32))
    assert sorted((repr(i), sorted(p)) for i, p in pieces.items()) == sorted((repr(i), sorted(p)) for i, p in expected.items())
    return len(sequences)


def expected_pieces(documents, capacity):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {}
    for doc_id, text in documents:
        ids = np.array([*reference.encode(text, add_special_tokens=False).ids, 0], "<u4")
        start, piece = 0, 0
        while start < len(ids):
            end = start + (len(ids) % capacity or capacity if start == 0 else capacity)
            expected.setdefault(doc_id, []).append((piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            start, piece = end, piece + 1
    return expected


def test_best_fit(tables, workspace):
    for frame, capacity in zip(tables, (64, 2048, 64), strict=True):
        path = public_tokenizers.path("byte_bpe_50k.json")
        rows = pack_documents(frame, path, workspace, capacity).collect()
        used = check_packing(rows, expected_pieces(texts_of(frame), capacity), capacity)
        assert used <= 1.02 * -(-sum(r.length for r in rows) // capacity) + 1


def test_reduction_keeps_the_optimum():
    def fewest(items, room=10):
        best = len(items)

        def place(rest, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if not rest:
                best = len(rooms)
                return
            for k in sorted({r: k for k, r in enumerate(rooms) if r >= rest[0]}.values()):
                place(rest[1:], [*rooms[:k], rooms[k] - rest[0], *rooms[k + 1 :]])
            place(rest[1:], [*rooms, room - rest[0]])

        place(sorted(items, reverse=True), [])
        return best

    rng = np.random.default_rng(9)
    for _ in range(150):
        items = rng.integers(1, 11, 9).tolist()
        packing = pack_lengths(dict(Counter(items)), 10)
        placed = Counter()
        for pattern, times in packing.patterns:
            assert sum(length * many for length, many in pattern) <= 10
            for length, many in pattern:
                placed[length] += many * times
        assert placed == Counter(items)
        used = sum(times for _, times in packing.patterns)
        fixed, left = packing.fixed, list((Counter(items)).elements())
        for pattern, times in packing.patterns[: packing.steps]:
            for length, many in pattern:
                for _ in range(many * times):
                    left.remove(length)
        assert fixed + fewest(left) == fewest(items)
        assert used <= fewest(items) + 1


def kept_by_rules(text):
    """The quality rules' verdict, with the limits of ``Bands`` looked up anew."""
    bands, w, data = Bands(), words(text), text.encode()
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    if len(w) < 50 or 2 * len(covered) > len(w):
        return False
    marks = re.findall(r"[#*$%&|<>]", text)
    if len(marks) > 0.1 * sum(map(len, w)) or len([x for x in w if not re.sub(r"[#*$%&|<>]", "", x)]) > 0.2 * len(w):
        return False

    def outside(part, low, high):
        ratio = len(zstandard.ZstdCompressor(level=3).compress(part)) / len(part)
        width = len(part) / max(1, len([byte for byte in part if byte & 0xC0 != 0x80]))
        return ratio * width < low or ratio > high * (1 + 0.2 * (width - 1))

    if outside(data, *[limits for least, *limits in bands.whole if len(data) >= least][-1]):
        return False
    fitting = [rest for least, *rest in bands.chunks if len(data) >= least]
    if not fitting:
        return True
    size, low, high = fitting[-1]
    starts = [*range(0, len(data) - size, size), len(data) - size]
    return 10 * sum(outside(data[at : at + size], low, high) for at in starts) <= len(starts)


def without_repeats(texts):
    split = [words(text) for text in texts]
    times = Counter(tuple(w[k : k + 35]) for w in split for k in range(len(w) - 34))
    gone = [{k + x for k in range(len(w) - 34) if times[tuple(w[k : k + 35])] > 1 for x in range(35)} for w in split]
    return [[x for k, x in enumerate(w) if k not in removed] for w, removed in zip(split, gone, strict=True)]


BASE_SECRETS = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}|AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}"""
)


def test_pipeline_by_plain_python(spark, corpus, tmp_path):
    """Each stage's decisions, worked out again in plain Python from what the stage before kept."""
    good = [row.text for row in corpus.orderBy("doc_id").collect() if kept_by_rules(row.text or "")][:40]
    passage = " ".join(f"passage{i % 53} of{i * i % 97} words{i}" for i in range(20))
    rows = [(i, text, "en", "site", len(text)) for i, text in enumerate(good)]
    planted = [good[0], good[1], good[2] + " end", good[3] + " " + passage, passage + "\n" + good[4], "spam spam " * 90, "", None]
    planted += [f'{good[5]} {good[6]}\npassword = "{HEX}"', base64.b64encode(np.random.default_rng(2).bytes(3000)).decode()]
    rows += [(100 + i, text, "en", "site", len(text or "")) for i, text in enumerate(planted)]
    frame = spark.createDataFrame(rows, corpus.schema).repartition(3)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality_rules"](spark, frame, "")
    expected = [(i, t) for i, t, *_ in rows if kept_by_rules(t or "")]
    assert texts_of(kept) == sorted(expected)
    assert 100 in dict(expected) and not {105, 106, 107, 109} & set(dict(expected))

    marks = {i: simhash(t) for i, t in expected}
    least = {i: i for i in marks}
    for _ in marks:
        for a in marks:
            least[a] = min(least[b] for b in marks if (marks[a] ^ marks[b]).bit_count() <= 4)
    expected = [(i, t) for i, t in expected if least[i] == i]
    single = stages["simhash_near_dedup"](spark, kept, "")
    assert texts_of(single) == sorted(expected) and not {100, 101} & set(dict(expected))

    cut = stages["substring_dedup"](spark, single, "")
    left = without_repeats([t for _, t in expected])
    assert [(i, words(t)) for i, t in texts_of(cut)] == sorted((i, w) for (i, _), w in zip(expected, left, strict=True))
    assert not any("passage7" in t for _, t in texts_of(cut))

    masked = stages["secret_scans"](spark, cut, "")
    before, after = texts_of(cut), texts_of(masked)
    assert any(BASE_SECRETS.search(t) for _, t in before) and not any(BASE_SECRETS.search(t) for _, t in after)
    assert all(a == b or MASK in b for (_, a), (_, b) in zip(before, after, strict=True))

    packed = stages["best_fit_packing"](spark, masked, "")
    assert check_packing(packed.collect(), expected_pieces(after, 2048), 2048)
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert rows_of(corpus_pipeline.run(spark, str(tmp_path)), *columns) == rows_of(packed, *columns)


def test_pipeline(spark, tmp_path):
    sf_dir = str(SF_DIR)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = texts_of(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert docs.columns == columns
            before, rows = len(rows), texts_of(docs)
            assert len(rows) <= before
    assert check_packing(docs.collect(), expected_pieces(rows, 2048), 2048)
    assert rows_of(corpus_pipeline.run(spark, sf_dir), "doc_id", "piece", "start", "length", "ids_crc32") == rows_of(
        docs, "doc_id", "piece", "start", "length", "ids_crc32"
    )


def test_other_work_frees_what_an_encoder_knows(spark):
    """A worker that packed documents judges others next."""
    encoder = byte_level_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    before = [ids.tolist() for ids in encoder.encode(["Deep wells and shallow ones"])]
    assert len(encoder.codes) and len(encoder.pieces)
    verdict().func(pd.Series(["Deep wells and shallow ones"]))
    assert not len(encoder.codes) and not len(encoder.pieces) and not len(encoder.ids)
    assert [ids.tolist() for ids in encoder.encode(["Deep wells and shallow ones"])] == before


def test_an_encoder_forgets_at_its_bound(spark):
    encoder = ByteLevelEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"well {n} of {n * 7919} metres" for n in range(300)]
    before = [ids.tolist() for ids in encoder.encode(texts)]
    encoder.most_chunks = 10
    for text, ids in zip(texts, before, strict=True):
        assert [found.tolist() for found in encoder.encode([text])] == [ids]
    assert len(encoder.codes) <= 10 + 5


def test_words_with_a_sign_behind_them_need_no_pattern():
    for kind, file in ((ByteLevelEncoder, "byte_bpe_50k.json"), (WordEndEncoder, "word_bpe_49k.json")):
        encoder = kind(public_tokenizers.path(file))
        text = " ".join(f"Well{mark} it{mark}" for mark in sorted(encoder.MARKS))
        assert [ids.tolist() for ids in encoder.encode([text])] == [encoder.tokenizer.encode(text, add_special_tokens=False).ids]
        encoder._forget()
        encoder.plain = encoder.matches = re.compile("")  # matches no chunk, so all others go to the library
        learned = []
        encoder.tokenizer = SimpleNamespace(encode_batch_fast=lambda texts, **_: learned.extend(texts) or [])
        assert len(next(iter(encoder.encode(["Deep wells, shallow ones; more"]))))
        assert learned == []
