import functools
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, pii
from quarry.llm import jump_shard as js
from quarry.llm import mixing as mx
from quarry.llm import training_order as to
from tests.llm.conftest import DOCS, by_sql, prose, untouched


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def test_ids_and_texts_equal_the_library(spark, odd, library):
    rnd = random.Random(4)
    alphabet = "ab é😀\n\t'st re ll 12½$.!?中あﬁ́  ẞ<|>"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(400)] + ["a" * 5000, " " * 3000 + "x", "<|endoftext|><|endoftext|>y", "we'll it's I'M"]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts, 1000)], DOCS).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    for row in bpe.encode(df.withColumnRenamed("lang", "ids_of")).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
        expected = library.encode(row.text or "", add_special_tokens=False).ids
        if row.doc_id is not None:
            assert row.ids == expected
        assert row.n_tokens == len(row.ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, row.ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(row.ids, skip_special_tokens=False).encode()).hexdigest()


def test_long_texts_are_cut_where_no_piece_crosses(monkeypatch, library):
    monkeypatch.setattr(bpe, "SEGMENT", 40)
    use = bpe.encoder(bpe.vocabulary(bpe.default_path()))
    rnd = random.Random(8)
    for _ in range(200):
        text = "".join(rnd.choice(["word", "  ", " ", "\n\n", "x", "12", "!?", "é"]) for _ in range(120))
        assert [i for s in use.encode(text) for i in s] == library.encode(text, add_special_tokens=False).ids


def test_decode_round_trip(spark, empty):
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(["a b", "", "é\n", None])], DOCS)
    back = bpe.decode(bpe.encode(df)).select("doc_id", "text").collect()
    assert {r.doc_id: r.text for r in back} == {0: "a b", 1: "", 2: "é\n", 3: ""}
    assert bpe.encode(empty).count() == 0


def test_permutation_is_a_bijection_with_an_inverse():
    for n in (1, 2, 3, 5, 17, 1000, 4097):
        x = np.arange(n)
        p = to.permuted(x, n)
        assert sorted(p) == list(x) and (to.permuted(p, n, back=True) == x).all()
    assert (to.permuted(np.arange(1000), 1000) != to.permuted(np.arange(1000), 1000, key=1)).any()


def ordinary(library, text):
    """Special tokens in a text are ordinary text here."""
    if "<|endoftext|>" in (text or ""):
        return to.encoding(to.ranks(to.default_path())).encode_ordinary(text)
    return library.encode(text or "", add_special_tokens=False).ids


def test_shards_hold_every_sequence_at_its_slot(spark, odd, library, tmp_path):
    tokens = to.written(to.tokenised(odd, length=16))
    sequences, total = to.ordered(tokens, length=16, shard_rows=64)
    shards = to.write_shards(sequences, total, f"file://{tmp_path}/shards", shard_rows=64)
    records, docs = {}, Counter()
    for s in shards.collect():
        assert s.first_slot == s.shard * 64 and zlib.crc32(s.content) == s.crc32 and len(s.content) == s.rows * s.stride
        for i in range(s.rows):
            records[s.first_slot + i] = (s.doc_ids[i], s.chunks[i], s.n_tokens[i], s.content[i * s.stride : (i + 1) * s.stride], s.numbers[i])
            docs[s.doc_ids[i]] += s.n_tokens[i]
    assert sorted(records) == list(range(total)) and sorted(r[4] for r in records.values()) == list(range(total))
    expected = Counter()
    for r in odd.collect():
        expected[r.doc_id] += len(ordinary(library, r.text)) + 1
    assert docs == expected
    ids = [i for _, _, n, data, _ in sorted((r for r in records.values() if r[0] == 9), key=lambda r: r[1]) for i in np.frombuffer(data, "<u2")[:n].tolist()]
    text = next(r.text for r in odd.collect() if r.doc_id == 9)
    assert ids == ordinary(library, text) + [50256]
    assert [r.shard for r in to.resume(shards, 130, 64).collect()] == sorted(s.shard for s in shards.collect() if s.shard >= 2)


def test_slots_do_not_depend_on_partitions(spark, odd, folder, tmp_path):
    rows = [(i if i % 7 else None, prose(i % 50, i % 50), "en", "s", 1) for i in range(300)] + [(5, "same text", "en", "s", 1)] * 200
    docs = spark.createDataFrame(rows, DOCS).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    found = []
    for n in (1, 7):
        sequences, total = to.ordered(to.written(to.tokenised(docs.repartition(n), length=16)), length=16, shard_rows=64)
        found.append(sorted((r.slot, r.number, r.doc_id is None, r.doc_id or 0, r.chunk, r.n_tokens, bytes(r.record)) for r in sequences.collect()))
        assert [r[0] for r in found[-1]] == list(range(total)) and sorted(r[1] for r in found[-1]) == list(range(total))
    assert found[0] == found[1]


def test_training_order_of_an_empty_table(spark, empty, folder):
    assert to.op2_query(spark, folder(documents=empty)).count() == 0


def plain_jump(key, n):
    p = js.PRIME
    step = lambda x: (x * x % p + x * 48_271 + 11) % p
    low, high = key % 65_536, (key // 65_536) % (p - 1)
    x = (low * 48_271 + high * 40_692 + 12_345) % p
    for _ in range(3):
        x = step(x)
    b, j = -1, 0
    while j < n:
        b, x = j, step(x)
        j = int((b + 1) * (float(p) / float(x + 1)))
    return b


def test_shards_by_jump_hash(spark, odd, folder):
    keys = [*range(3000), -1, -5, 2**62, -(2**62)]
    df = spark.createDataFrame([(k, "t", "en", "s", 1) for k in keys], DOCS)
    out = js.op10_query(spark, folder(documents=df)).collect()
    for r in out:
        assert (r.shard, r.grown_shard) == (plain_jump(r.doc_id, 40), plain_jump(r.doc_id, 41)) and r.grown_shard in (r.shard, 40)
    sizes = Counter(r.shard for r in out)
    assert len(sizes) == 40 and max(sizes.values()) < 2 * len(out) / 40
    assert 0.4 < sum(r.grown_shard == 40 for r in out) / (len(out) / 41) < 2


def test_sharding_equals_sql_whatever_the_partitions(spark, folder):
    rows = [(i if i % 9 else None, [None, "", "é\n" * (i % 40), prose(i, i % 30)][i % 4], "en", "s", 1) for i in range(-20, 700)] + [(3, "again", "en", "s", 1)] * 400
    docs = spark.createDataFrame(rows, DOCS)
    path = folder(documents=docs)
    expected = Counter(tuple(x[c] for c in sorted(x)) for x in by_sql(path, js.ORACLE, "documents"))
    got = [x.asDict() for x in js.op10_query(spark, path).collect()]
    assert Counter(tuple(x[c] for c in sorted(x)) for x in got) == expected
    for pieces in (1, 16):
        js.PIECE_ROWS, before = max(1, len(rows) // js.SHARDS // pieces), js.PIECE_ROWS
        try:
            again = js.assigned(docs.repartition(5).select(*js.measured(docs)), js.SHARDS).collect()
        finally:
            js.PIECE_ROWS = before
        assert Counter((r.key, r.size, r.crc, r.shard, r.slot) for r in again) == Counter((x["doc_id"], x["size"], x["text_crc32"], x["shard"], x["slot"]) for x in got)


def test_sharding_odd_rows(spark, odd, folder, clashing):
    rows = js.op10_query(spark, folder(documents=odd)).collect()
    texts = {(r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 16) for r in odd.collect()}
    assert len(rows) == odd.count() and {(r.doc_id, r.text_crc32, r.size) for r in rows} == texts
    slots = {}
    for r in untouched(clashing, js.shard(clashing, 5)):
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 30


def test_sharding_an_empty_table(spark, empty, folder):
    assert js.op10_query(spark, folder(documents=empty)).count() == 0


def plain_shares(sizes, weights, most=3):
    target, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        by = sum(weights[i % len(weights)] for i in free)
        over = [i for i in free if left * weights[i % len(weights)] / by > most * sizes[i]]
        for i in over or free:
            target[i] = float(most * sizes[i]) if over else left * weights[i % len(weights)] / by
        if not over:
            break
        left, free = left - sum(target[i] for i in over), [i for i in free if i not in over]
    return target


def test_shares_by_weight_with_a_limit(spark):
    rnd = random.Random(6)
    for sizes in ([100, 100, 100], [1000, 10, 20], [0, 0], [5], [rnd.choice([0, 1, 10, 500, 10_000]) for _ in range(40)]):
        df = spark.createDataFrame(list(enumerate(sizes)), "source_no long, source_size long")
        got = {r.source_no: r.target for r in mx.shares(df, (1.0, 2.0, 3.0)).collect()}
        assert [got[i] for i in range(len(sizes))] == pytest.approx(plain_shares(sizes, (1.0, 2.0, 3.0)))
    assert mx.shares(spark.createDataFrame([], "source_no long, source_size long"), (1.0,)).count() == 0


def test_sources_are_numbered_by_code_point(spark):
    names = ["b", "a", "", "é", "Z", "😀", "\uffff", None, "aa"] + [f"s{i:05}" for i in range(3000)]
    out = mx.numbered(spark.createDataFrame([(n,) for n in names], "source string").repartition(9), F.col("source").isNull().asc(), F.col("source").asc())
    order = sorted((n for n in names if n is not None)) + [None]
    assert {r.source: r.source_no for r in out.collect()} == {n: i for i, n in enumerate(order)}


def test_tilts_solve_the_dual(spark):
    """The conditions of Karush, Kuhn and Tucker, which tell the only solution of a convex problem."""
    rnd = random.Random(9)
    bands = [[rnd.choice([0, 0, 50, 400, 3000, 20_000]) for _ in range(mx.BANDS)] for _ in range(12)]
    rows = []
    for i, b in enumerate(bands):
        size = sum(b)
        rows.append((i, size, *b, float(size * [0.2, 1, 2, 2.9, 3, 0][i % 6])))
    schema = f"source_no long, source_size long, {', '.join(f'band_{i} long' for i in range(mx.BANDS))}, target double"
    sources = spark.createDataFrame(rows, schema)
    sources = sources.withColumn("state", mx.state(sources)).cache()
    tilts = mx.balance(sources)
    assert any(abs(t) > 0.01 for t in tilts)
    a = {r.source_no: r.a for r in sources.select("source_no", F.when(F.col("state") == "free", mx.own_tilt(tilts)).alias("a")).collect()}
    tokens, total = np.zeros(mx.BANDS), sum(r[-1] for r in rows)
    for i, size, *b, target in rows:
        rate = [3.0 if target >= 3 * size else 0.0 if not target else min(3.0, math.exp(a[i] + t)) for t in tilts]
        own = np.array(b) * rate
        assert own.sum() == pytest.approx(target, rel=1e-9)  # every source is met
        tokens += own
    raw = np.array([sum(b[j] for b in bands) for j in range(mx.BANDS)], float)
    want = raw / raw.sum() * total
    assert tokens - want + mx.SLACK * want * np.array(tilts) == pytest.approx(np.zeros(mx.BANDS), abs=1e-6 * total)


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mx, "FEW_SOURCES", 1000)  # beyond it, sources are joined
    docs = spark.range(10_001).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id")).alias("source"), (F.col("id") % 50 + 1).alias("size"))
    out = mx.plan(docs, "doc_id").agg(F.count(F.lit(1)), F.sum("total"), F.max(F.col("total") / F.col("n"))).first()
    assert out[0] == 10_001 and out[2] <= 3


def test_long_documents_and_copies_leave_a_source_at_its_target(spark, monkeypatch):
    monkeypatch.setattr(mx, "BLOCK_ROWS", 50)
    rows = [(i, "a", 20 + i % 30) for i in range(2000)] + [(5000 + i, "a", 9_000) for i in range(7)] + [(7777, "a", 33)] * 2500 + [(10_000 + i, "b", 40) for i in range(3000)]
    out = mx.plan(spark.createDataFrame(rows, "doc_id long, source string, size long"), "doc_id").collect()
    assert sum(r.n for r in out) == len(rows)
    for source in ("a", "b"):
        own = [r for r in out if r.source == source]
        assert abs(sum(r.total * r.size for r in own) - own[0].target) <= 0.002 * own[0].target
        assert all(0 <= r.total <= 3 * r.n for r in own)


def test_mix_meets_targets(spark, folder):
    rnd = random.Random(2)
    rows = [(i, prose(i, rnd.choice([1, 5, 40, 90, 300])), "en", f"s{i % 7}" if i % 11 else None, 1) for i in range(900)]
    path = folder(documents=spark.createDataFrame(rows, DOCS))
    out = mx.op6_query(spark, path).collect()
    assert sorted(out) == sorted(mx.op6_query(spark, path).collect()) and len(out) == 900
    source = {i: s for i, _, _, s, _ in rows}
    taken, target = Counter(), {}
    for r in out:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size and r.size == len(rows[r.doc_id][1].split())
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 5 for s in target)
    assert sum(target.values()) == pytest.approx(sum(r.size for r in out))


def test_mix_of_odd_rows_and_empty_tables(spark, odd, empty, folder, clashing):
    path = folder(documents=odd)
    assert len(mx.op6_query(spark, path).collect()) == odd.count()
    assert mx.stage(spark, odd, path).columns == odd.columns
    assert mx.stage(spark, empty, path).count() == 0
    taken = Counter(r.doc_id for r in untouched(clashing, mx.mixed(clashing)))
    assert all(n <= 3 for n in taken.values()) and taken


def test_a_mix_takes_rows_as_often_as_planned(spark, monkeypatch):
    monkeypatch.setattr(mx, "CHUNK", 16)
    rows = [(i, prose(i, 30), "en", f"s{i % 3}", 1) for i in range(60)] + [(900, prose(900, 30), "en", "s1", 1)] * 101
    docs = spark.createDataFrame(rows, DOCS)
    plan = mx.plan(docs.select("doc_id", "source", mx.words(F.col("text")).alias("size")), "doc_id").collect()
    taken = Counter(r.doc_id for r in mx.mixed(docs).collect())
    assert sum(taken.values()) == sum(r.total for r in plan)
    for s in ("s0", "s1", "s2"):
        words = sum(30 * n for i, n in taken.items() if (f"s{i % 3}" if i < 900 else "s1") == s)
        assert abs(words - next(r.target for r in plan if r.source == s)) <= 30


def test_counting_words(spark):
    from pyspark.sql import functions as F

    texts = [None, "", " ", "a", " a", "a ", "a  b\x0bc", " ", "a\x1cb", "\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mx.words(F.col("t")).alias("n"))
    import re

    assert all(r.n == len(re.findall(r"[^\x20\x09-\x0D]+", r.t or "")) for r in df.collect())


def test_base_spans_equal_the_plain_patterns():
    import re

    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def plain(text):
        for kind, pattern in enumerate(patterns):
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == 0 or (kind == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (kind == 2 and 12 <= len(digits) <= 19 and pii.luhn(digits)) or (kind == 3 and 9 <= len(digits) <= 15):
                    yield m.start(), kind, m.end()

    rnd = random.Random(1)
    for _ in range(20_000):
        text = "".join(rnd.choice("a.@1 2-+(3)4%é25") for _ in range(rnd.randrange(60)))
        assert sorted(plain(text)) == pii.base_spans(text)


def test_boosted_spans_are_added_to_base_ones(spark, folder):
    rnd, rows = random.Random(3), []
    for i in range(700):
        number = f"{rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}"
        what = [f"call +1 ({number}", f"phone +1 ({number}", f"mail bob{i}@x{i}.example.com", f"host 10.1.{i % 255}.7", f"serial 77{rnd.randrange(10**6)}", "nothing"][i % 6]
        rows.append((i, f"{prose(i, 20)} {what} {prose(i + 1, 10)}", "en", "s", 1))
    rows.append((9000, "", "en", "s", 1))
    path = folder(documents=spark.createDataFrame(rows, DOCS))
    for r in pii.op4_query(spark, path).collect():
        text = rows[min(r.doc_id, 700)][1]
        base = pii.base_spans(text)
        assert r.base_sha256 == hashlib.sha256(pii.digest(base).encode()).hexdigest()
        assert set(pii.digest(base).split(",")) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in base) for i in range(4))
        if r.doc_id % 6 == 5:
            assert not r.spans


def test_spans_in_other_formats_are_added(spark):
    rnd, rows, hidden = random.Random(5), [], {}
    for i in range(1500):
        number = f"{rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}"
        name, place = f"bob{rnd.randrange(10, 99)}", f"x{1000 + i}"
        kind = i % 6
        what = [f"call +1 ({number}", f"mail {name}@{place}.example.com", f"serial 77{rnd.randrange(10**6):06}", f"token a{rnd.randrange(10**9):09}f", f"host 10.1.{i % 255}.7", "nothing"][kind]
        if kind == 5 and i % 5 == 0:
            hidden[i] = [f"({number}", f"1 ({number}", f"{name} [at] {place} [dot] example [dot] com", f"{name} at {place} dot example dot com"][i // 30 % 4]
            what = f"{'call' if hidden[i][0] in '(1' else 'mail'} {hidden[i]}"
        rows.append((i, f"{prose(i, 20)} {what} {prose(i + 1, 10)}", "en", "s", 1))
    found = pii.written(pii.find(spark.createDataFrame(rows, DOCS).select("text", "doc_id")))
    selected = pii.select(found, pii.train(found))
    out = {r.doc_id: r.spans for r in selected.collect()}
    for i, span in hidden.items():
        at = rows[i][1].index(span)
        assert out[i] == f"{'phone' if span[0] in '(1' else 'email'}:{at}:{at + len(span)}"
    assert all(bool(spans) == (i in hidden or i % 6 in (0, 1, 4)) for i, spans in out.items())
    assert pii.added(selected).first()[:] == (1500, 750, 24, 0, 0, 26)


def test_an_address_is_proposed_in_any_text_and_case():
    for span in ("bob at example.com", "bob AT x DOT com", "bob [AT] x [Dot] com", "bob at x.com"):
        for text in (span, f"{span} . a dot"):
            assert (0, pii.EMAIL, len(span)) in pii.candidates(text)
    assert pii.masked("bob [AT] x [Dot] com", pii.EMAIL) == "bob@x.com"


def test_no_feature_tells_a_base_span():
    def seen(text, span, kind):
        return pii.features(text, text.index(span), kind, text.index(span) + len(span))

    plain = seen("mail bob@x.com now", "bob@x.com", pii.EMAIL)
    for span in ("bob [at] x [dot] com", "bob(at)x.com", "bob at x dot com"):
        assert seen(f"mail {span} now", span, pii.EMAIL) == plain
    for span in ("(555) 123-4567", "1 (555) 123-4567", "001 (555) 123-4567"):
        assert seen(f"call {span} now", span, pii.PHONE) == seen("call +1 (555) 123-4567 now", "+1 (555) 123-4567", pii.PHONE)
    assert seen("card 4444.3333.2222.1111", "4444.3333.2222.1111", pii.CARD) == seen("card 4444 3333 2222 1111", "4444 3333 2222 1111", pii.CARD)


def test_boosted_trees_on_held_out_rows():
    from quarry.llm.boosting import BoostedTrees

    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = BoostedTrees().fit(x[:2000], y[:2000]).calibrate(x[2000:3000], y[2000:3000])
    assert ((model.probability(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.95


def with_check_digit(rnd, prefix):
    digits = prefix + "".join(str(rnd.randrange(10)) for _ in range(15 - len(prefix)))
    return next(digits + str(d) for d in range(10) if pii.luhn(digits + str(d)))


def test_cards_beside_other_numbers_are_added(spark):
    rnd, rows, hidden = random.Random(11), [], {}
    for i in range(1500):
        card = with_check_digit(rnd, "4")
        card = " ".join(card[k : k + 4] for k in range(0, 16, 4)) if i % 8 == 1 else card
        what = ["nothing", f"card {card} and", f"serial {rnd.randrange(10**9):09} {rnd.randrange(10**6):06}", "more"][i % 4 if i % 40 else 3]
        if i % 40 == 0:
            hidden[i] = with_check_digit(rnd, "4")
            what = f"card {hidden[i]} {rnd.randrange(1000, 9999)} and"
        rows.append((i, f"{prose(i, 20)} x {what} {prose(i + 1, 10)} y", "en", "s", 1))
    found = pii.written(pii.find(spark.createDataFrame(rows, DOCS).select("text", "doc_id")))
    selected = pii.select(found, pii.train(found))
    out = {r.doc_id: r for r in selected.collect()}
    for i, card in hidden.items():
        at = rows[i][1].index(card)
        if not pii.base_spans(rows[i][1]):
            assert f"card:{at}:{at + 16}" in out[i].spans.split(","), (rows[i][1], out[i].spans)
    # numbers that are no cards by format stay as they are
    assert all(out[i].spans == pii.digest(pii.base_spans(rows[i][1])) for i in out if i % 4 == 2 and i % 40)


def test_runs_of_digit_groups_propose_whole_groups_only():
    text = "x 4111111111111111 4111111111111111 7 y"
    spans = pii.swallowed(text)
    assert (2, pii.CARD, 18) in spans and (19, pii.CARD, 35) in spans
    assert pii.swallowed("12345678901234567890123456789") == [] and pii.swallowed("1 2 3") == []


def test_candidates_are_drawn_from_all_of_a_document(spark):
    many = " ".join(f"call ({200 + i}) 555-{1000 + i} or" for i in range(300))
    found = pii.written(pii.find(spark.createDataFrame([(1, many, "en", "s", 1)], DOCS).select("text", "doc_id")))
    x, stands, half = pii.drawn(found)
    assert len(x) == len(stands) == 300 and len(set(half)) == 1
    assert len(pii.drawn(found, limit=40)[0]) <= 40


def test_shards_and_ids_are_made_of_whole_arrays(spark, tmp_path):
    texts = [prose(1, 300), "<|end|> and <|endoftext|> é 😀", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = [to.encoding(to.ranks(to.default_path())).encode_ordinary(t or "") for t in texts]
    tokens = to.written(to.tokenised(docs, length=4))
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist()[: r.n_tokens - 1] for r in tokens.collect()}
    assert got == dict(enumerate(plain))
    sequences, total = to.ordered(tokens, 4, 8)
    shards = to.write_shards(sequences, total, f"{tmp_path}/shards", 8).collect()
    rows = sorted((r.slot, bytes(r.record)) for r in sequences.collect())
    assert [b"".join(x for _, x in rows[r.first_slot : r.first_slot + r.rows]) for r in sorted(shards)] == [bytes(r.content) for r in sorted(shards)]
    assert sum(r.rows for r in shards) == total == len(rows) and all(r.crc32 == zlib.crc32(r.content) for r in shards)


def many_candidates(spark, docs, serials):
    """Documents of many numbers that are nothing and, in two of three, an address of a host."""
    rnd = random.Random(23)
    rows = []
    for i in range(docs):
        what = [f"serial 77{rnd.randrange(10**6):06}" for _ in range(serials)] + [f"call +1 (555) 123-{rnd.randrange(1000, 9999)}"]
        rows.append((i, " or ".join(what + [f"host 110.121.{rnd.randrange(10, 99)}.77"] * (i % 3 > 0)), "en", "s", 1))
    return pii.written(pii.find(spark.createDataFrame(rows, DOCS).select("text", "doc_id")))


def test_all_candidates_are_learnt_from(spark):
    found = many_candidates(spark, 300, 200)
    model, thresholds = pii.train(found)
    assert thresholds[pii.IP] < 2  # 200 base spans of some 60,000 candidates: enough for a bound, a third of them would not be
    assert pii.added(pii.select(found, (model, thresholds))).first().base_spans == 500


def test_sums_by_tasks_give_the_same_trees(spark, monkeypatch):
    found = many_candidates(spark, 200, 5)
    monkeypatch.setattr(pii, "BoostedTrees", functools.partial(pii.BoostedTrees, rounds=3))
    kept, ours = pii.train(found)
    monkeypatch.setattr(pii, "HELD", 0)
    summed, theirs = pii.train(found)
    assert ours == theirs
    for a, b in zip(kept.models, summed.models):
        assert (a.base, a.a, a.b) == (b.base, b.a, b.b) and all(np.array_equal(x, y) for s, t in zip(a.trees, b.trees) for x, y in zip(s, t))


def test_personal_data_in_odd_rows_and_an_empty_table(spark, odd, empty, clashing):
    out = pii.redact(odd).collect()
    assert len(out) == odd.count()
    text = next(r.text for r in out if r.doc_id == 9)
    assert text.startswith("mail me: [email] or [phone], ip [ip]")
    assert pii.redact(empty).count() == 0
    assert len(untouched(clashing, pii.redact(clashing))) == 30


def test_added_columns_take_the_place_of_those_of_their_name(spark, odd):
    own = odd.withColumns({"n_tokens": F.lit("x"), "ids": F.lit("y"), "spans": F.lit("z")})
    assert all(isinstance(r.n_tokens, int) and isinstance(r.ids, list) for r in bpe.encode(own).collect())
    assert all(r.spans != "z" and r.n_tokens == "x" for r in pii.redact(own).collect())
