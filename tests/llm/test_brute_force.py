"""Each operator against a plain computation of the same, on the smallest tables."""

import dataclasses
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import tiktoken
import xxhash

from quarry.llm import ann, bpe, common, html, langid, media, mixing, queries, quality, simhash, toxicity


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r for r in common.table(spark, sf_dir, "documents").collect()}


# ---- mixing


def test_targets_share_and_stop():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 450, 2) == [200, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    got = mixing.targets([10, 1000, 10], [3, 1, 2], 1530, 2)
    assert got == [20, 1490, 20]
    assert mixing.targets([], [], 0, 2) == [] and mixing.targets([0], [3], 0, 2) == [0]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutation_is_one_to_one(n):
    i = np.arange(n)
    key = np.full(n, 12345, np.uint64)
    out = mixing.permute(i, np.full(n, n), key)
    assert sorted(out) == list(range(n))
    assert (mixing.permute(out, np.full(n, n), key, inverse=True) == i).all()


def test_slot_count_gives_the_quota():
    for size, quota, block in itertools.product((1, 5, 64, 65, 200), (0, 1, 7, 64, 199, 400), (1, 8, 64)):
        quota = min(quota, 2 * size)
        n, last = mixing.slot_count(size, quota, block, 17, 0)
        blocks = -(-size // block)
        total = 0
        for slot in range(n):
            key = mixing._key(17, np.array([0]), np.array([slot // blocks]))
            at = int(mixing.permute(np.array([slot % blocks]), np.array([blocks]), key)[0])
            total += last if slot == n - 1 else min(block, size - at * block)
        assert total == quota


def test_mix_meets_targets(spark, sf_dir, texts):
    first = queries.op1_mix(spark, sf_dir).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, queries.op1_mix(spark, sf_dir).collect()))
    sums, goals = {}, {}
    for r in first:
        n = len((texts[r.doc_id].text or "").encode().split())
        assert r.size == n and 0 <= r.taken <= 2 * n
        source = texts[r.doc_id].source
        sums[source] = sums.get(source, 0) + r.taken
        goals[source] = r.target
    assert all(abs(sums[k] - goals[k]) <= 1 for k in goals)
    assert sum(goals.values()) == pytest.approx(1.5 * sum(r.size for r in first))


def test_spans_of_the_mix_are_its_text(spark, sf_dir, texts):
    docs = common.table(spark, sf_dir, "documents")
    taken = {r.doc_id: r.taken for r in mixing.taken(docs).collect()}
    words = {}
    for r in mixing.mixed_documents(docs).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
        assert r.n_chars == len(r.text)
        own = texts[r.doc_id].text
        assert r.text == own or set(r.text.split()) <= set(own.split())
    assert words == {k: v for k, v in taken.items() if v}


# ---- byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    s = bpe.Settings()
    return tiktoken.Encoding("own", pat_str=s.pattern, mergeable_ranks=bpe.read_ranks(s.path), special_tokens={})


def test_merge_equals_the_library(encoding):
    ranks = bpe.read_ranks(bpe.Settings().path)
    rng = random.Random(1)
    for _ in range(500):
        word = "".join(rng.choice("abcdeé漢🙂 \n1x") for _ in range(rng.randint(1, 60)))
        assert bpe.merge(word.encode(), ranks) == encoding._encode_single_piece(word)


def test_bpe_of_documents(spark, sf_dir, texts, encoding):
    got = queries.op3_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id].text or ""
        ids = encoding.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_round_trip_by_joins(spark, sf_dir, texts):
    some = common.table(spark, sf_dir, "documents").filter("doc_id < 40")
    for r in bpe.decode(bpe.encode(some, bpe.Settings(chunk=20_000))).collect():
        assert bytes(r.bytes).decode() == (texts[r.doc_id].text or "")


# ---- SimHash


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, limit):
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= limit:
            up[find(j)] = find(i)
    return [find(i) for i in range(len(fps))]


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_simhash_of_documents(spark, sf_dir, texts):
    got = sorted(queries.op6_simhash(spark, sf_dir).collect(), key=lambda r: r.doc_id)
    fps = [plain_fingerprint(texts[r.doc_id].text) for r in got]
    assert [r.fingerprint for r in got] == [f"{f:016x}" for f in fps]
    assert same_partition(plain_components(fps, 3), [r.component_id for r in got])
    for r in got:
        assert r.component_id == min(x.doc_id for x in got if x.component_id == r.component_id)


@pytest.mark.parametrize("hot", [20_000, 20])
def test_forest_finds_all_links(spark, hot):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    fps = [s ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for s in seeds for _ in range(12)]
    fps += [rng.getrandbits(16) for _ in range(400)]  # all agree in three blocks
    fps = sorted({f % 2**64 for f in fps})
    rows = [(f - 2**64 if f >> 63 else f, [f - 2**64 if f >> 63 else f]) for f in fps]
    nodes = spark.createDataFrame(rows, "node long, fp array<long>")
    roots = {r.u: r.v for r in simhash.components(simhash.edges(nodes, simhash.Settings(hot=hot))).collect()}
    assert same_partition(plain_components(fps, 3), [roots.get(n, n) for n, _ in rows])


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(1000, 999)], "u long, v long")
    got = {r.u: r.v for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 1000: 999}


def test_wide_fingerprints_catch_near_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, own = [], {}
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(300)]
        for c in range(4):
            words = list(base)
            for _ in range(2 * c):  # each change breaks five shingles: a similarity of 0.82 at least
                words[rng.randrange(300)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
            own[len(rows) - 1] = g
    got = {r.doc_id: r.component_id for r in simhash.grouped(spark.createDataFrame(rows, "doc_id long, text string"), simhash.WIDE).collect()}
    assert all(own[i] == own[c] for i, c in got.items())
    assert len(set(got.values())) == 40


def plain_similar(texts, k=5):
    """Smallest place of each text's group: links are five-word sets with a Jaccard similarity of 0.8 or more."""
    sets = []
    for t in texts:
        words = t.lower().split()
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))})
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            up[b] = a
    return [find(i) for i in range(len(sets))]


def similar_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.grouped(rows, simhash.WIDE).collect()}
    return [got[i] for i in range(len(texts))]


def test_near_copies_equal_brute_force(spark):
    """Pairs about the threshold: none of those at 0.8 is lost, none below is linked."""
    rng = random.Random(11)
    texts = []
    for _ in range(250):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((20, 60, 200, 300)))]
        copy = list(base)
        for at in rng.sample(range(len(base)), max(1, round(len(base) * rng.uniform(0.005, 0.035)))):
            copy[at] = "changed"
        texts += [" ".join(base), " ".join(copy)]
    want = plain_similar(texts)
    assert 300 < len(set(want)) < 450
    assert similar_of(spark, texts) == want


def test_repeated_lines_do_not_link_documents(spark):
    """A repeated line weighs by its count in a fingerprint, but once in a set."""
    rng = random.Random(12)
    line = " ".join(f"l{i}" for i in range(12))
    texts = [" ".join([line] * 40 + [f"w{rng.randrange(5000)}" for _ in range(60)]) for _ in range(12)]
    assert plain_similar(texts) == list(range(12))
    assert similar_of(spark, texts) == list(range(12))


def test_small_hot_groups_lose_no_near_copies(spark):
    """Groups of any size are searched whole: hot = 1 split every group before."""
    rng = random.Random(13)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for _ in range(3):
            copy = list(base)
            for at in rng.sample(range(300), 5):
                copy[at] = f"w{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.grouped(rows, dataclasses.replace(simhash.WIDE, hot=1)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_similar(texts)


@pytest.mark.parametrize("tile, tile_shingles", [(4, 1 << 20), (1024, 600), (1024, 1 << 20)])
def test_cells_of_any_size_lose_no_links(spark, tile, tile_shingles):
    """A family whose members are about as similar as the threshold: most are linked, the others meet in many small cells."""
    rng = random.Random(17)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = []
    for _ in range(120):
        copy = list(base)
        for at in rng.sample(range(200), rng.choice((1, 2, 3, 4, 6, 9))):
            copy[at] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    want = plain_similar(texts)
    assert 20 < len(set(want)) < 110
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.grouped(rows, dataclasses.replace(simhash.WIDE, tile=tile, tile_shingles=tile_shingles)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_rows_without_ids_stay_only_alone(spark):
    words = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(1, words("a")), (None, words("a")), (None, words("b")), (None, words("b")), (5, words("c")), (5, words("d")), (None, None), (7, None)]
    got = sorted((str(r.doc_id), r.text or "") for r in simhash.kept(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("1", words("a")), ("None", words("b")), ("5", words("c")), ("5", words("d")), ("7", "")])


# ---- media


def plain_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index = min(block[2], 88)
    out = [value]
    for b in block[4:]:
        for code in (b & 15, b >> 4):
            step = int(media.STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(value)
    return out


def test_adpcm_equals_a_loop():
    blocks = np.random.default_rng(1).integers(0, 256, (50, 64), dtype=np.uint8)
    assert (media.decode_adpcm(blocks) == np.array([plain_adpcm(bytes(b)) for b in blocks])).all()


def test_companding_tables():
    """Known values of the standard: the ends and the middle of either law."""
    mu, a = media.EXPAND["mulaw"], media.EXPAND["alaw"]
    assert (mu[0x00], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert sorted(set(map(int, mu))) == sorted(-x for x in set(map(int, mu)))


def test_media_of_documents(spark, sf_dir, texts):
    for r in queries.op7_media(spark, sf_dir).collect():
        raw = (texts[r.doc_id].text or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_wave_round_trip():
    for codec in media.CODECS:
        for size in (64, 128, 6400):
            payload = np.random.default_rng(size).bytes(size)
            assert media.read_wave(media.write_wave(payload, codec)) == (codec, payload)
    with pytest.raises(ValueError):
        media.read_wave(b"RIFF")


# ---- neighbours


def test_recall(spark, sf_dir):
    rows = common.table(spark, sf_dir, "embeddings").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], float)
    got = {}
    for r in queries.op8_ann(spark, sf_dir).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        own = got[ids[i]]
        assert sorted(own) == list(range(1, 21))
        assert [own[k] for k in range(1, 21)] == sorted(own.values(), key=lambda v: (-v[1], v[0]))
        for v, s in own.values():
            assert s == pytest.approx(float(x[np.flatnonzero(ids == v)[0]] @ x[i]), abs=1e-12)
        hits += len({ids[b] for b in best} & {v for v, _ in own.values()})
        total += 20
    assert hits / total >= 0.9


def test_shards_split_large_cells():
    first, spread = ann.shards(np.array([10, 20, 100, 5]), 30)
    assert list(first) == [0, 0, 1, 5] and list(spread) == [1, 1, 4, 1]


# ---- classifiers and language


def held(spark, sf_dir, query):
    return [r for r in query(spark, sf_dir).collect() if r.held_out]


@pytest.mark.parametrize("query, label, least", [(queries.op5_quality, "quality", 0.9), (queries.op9_toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, query, label, least):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[label] for r in common.table(spark, sf, "labels").collect()}
    got = [(r.predicted, labels[r.doc_id]) for r in held(spark, sf, query) if r.doc_id in labels]
    assert len(got) > 30 and np.mean([a == b for a, b in got]) >= least


def test_held_out_rows(spark, sf_dir):
    for query, modulus, remainder in ((queries.op4_langid, 3, 1), (queries.op5_quality, 4, 2), (queries.op9_toxicity, 5, 0)):
        for r in query(spark, sf_dir).collect():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) and 0 <= r.score <= 1


def test_languages(spark, sf_dir, texts):
    got = queries.op4_langid(spark, sf_dir).collect()
    right = [r.lang_pred == texts[r.doc_id].lang for r in got if r.held_out]
    assert np.mean(right) >= 0.95


def test_factorisation_machine_identity():
    rng = np.random.default_rng(2)
    s = quality.Settings(bits=6, rank=3)
    m = quality.Model(s, 0.3, rng.normal(size=64 + quality.N_STATS), rng.normal(size=(64 + quality.N_STATS, 3)), np.zeros(quality.N_STATS), np.ones(quality.N_STATS))
    stats, row, index, value = quality.features(["a b a c.", "", "x Y z\nx Y z"], 6)
    got = quality.raw_scores(m, stats, row, index, value)
    for d in range(3):
        x = np.zeros(64 + quality.N_STATS)
        x[index[row == d]] = value[row == d]
        x[64:] = np.clip(stats[d], -4, 4)
        pairs = sum(m.v[i] @ m.v[j] * x[i] * x[j] for i, j in itertools.combinations(np.flatnonzero(x), 2))
        assert got[d] == pytest.approx(m.bias + m.w @ x + pairs)


def test_features_do_not_depend_on_neighbours():
    texts = ["one line", "two\nlines", "", "two\ntwo\n\ntwo", "x " * 50, "\n"]
    stats, row, index, value = quality.features(texts, 8)
    for i, t in enumerate(texts):
        own, _, at, v = quality.features([t], 8)
        assert np.array_equal(own[0], stats[i]) and np.array_equal(at, index[row == i]) and np.allclose(v, value[row == i])
    assert [round(np.expm1(x)) for x in stats[:, 15]] == [1, 2, 0, 3, 1, 0] and stats[3, 13] == pytest.approx(2 / 3)


def test_n_grams_equal_a_loop():
    texts = ["Idiot!! you", "", None, "aé b longer words"]
    doc, key = toxicity._grams(texts)
    found = {}
    for d, k in zip(doc, key):
        found.setdefault(int(d), []).append(int(k))
    for i, t in enumerate(texts):
        data = b" " + toxicity.fold(t) + b" "
        n = sum(b" " not in data[a + 1 : a + k - 1] for k in toxicity.ORDERS for a in range(len(data) - k + 1))
        assert len(found.get(i, [])) == n


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    s = langid.Settings(block=3)
    m = langid.Model(s, ["a", "b"], np.zeros((1, 2)), rng.normal(size=2), rng.normal(size=(2, 2)))
    doc = np.array([0] * 7 + [2] * 2 + [3])
    scores = rng.normal(size=(len(doc), 2)).astype(np.float32)
    counted = rng.random(len(doc)) > 0.3
    got = langid.marginal_sums(scores, counted, doc, 4, m)
    for d in range(4):
        at = np.flatnonzero(doc == d)
        want, total = np.zeros(2), 0.0
        for path in itertools.product((0, 1), repeat=len(at)):
            if not len(at):
                break
            w = np.exp(m.start[path[0]] + sum(m.move[a, b] for a, b in zip(path, path[1:])) + sum(scores[i, p] for i, p in zip(at, path)))
            total += w
            for i, p in zip(at, path):
                want[p] += w * counted[i]
        assert got[d] == pytest.approx(want / total if total else want, abs=1e-6)


def test_code_switched_text(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents")
    m = langid.train(docs, langid.allowed())
    own = {r.lang: r.text for r in docs.filter("n_chars between 800 and 2000").orderBy("doc_id").collect()}
    for a, b in itertools.permutations(sorted(own), 2):
        text = " ".join(own[a].split()[:60] + own[b].split()[:20])
        assert langid.predict(m, [text])[0] == [a]


# ---- html


def plain_template(pages, support=0.5):
    """Text tokens (path, text) of a host's template, by explicit occurrence vectors over its different pages; pages are lists of
    (path, text or None), in order."""
    pages = [list(p) for p in dict.fromkeys(map(tuple, pages))]
    if len(pages) < 3:
        return set()
    classes = {}
    for t in {t for p in pages for t in p}:
        classes.setdefault(tuple(p.count(t) for p in pages), []).append(t)
    out = set()
    for vector, members in classes.items():
        if len(members) < 2 or sum(map(bool, vector)) < support * len(pages):
            continue
        groups = {}
        for path, text in members:
            groups.setdefault(path if text is not None else path.rpartition("/")[0], []).append((path, text))
        for group in groups.values():
            orders = set()
            for p, n in zip(pages, vector):
                if n:
                    run = [t for t in p if t in group]
                    orders.add(tuple(run[: len(group)]) if run == run[: len(group)] * n else p.index(run[0]) + 1j)
            if len(orders) == 1 and not isinstance(next(iter(orders)), complex):
                out |= {t for t in group if t[1] is not None}
    return out


def nameless_pages(rng, n):
    """Pages without telling names: a fixed menu, a box on some pages, two notes that change places, an article, a closing line."""
    out = []
    for i in range(n):
        word = lambda: f"w{rng.randrange(10**6)}"
        notes = ["<p>Note one</p>", "<p>Note two</p>"]
        rng.shuffle(notes)
        box = "<table><tr><td>Seen today</td></tr></table>" if i % 3 else ""
        body = "".join(f"<p>{' '.join(word() for _ in range(20))}</p>" for _ in range(rng.randrange(1, 4)))
        out.append(f"<html><body><div><ul><li>Start</li><li>All pages</li></ul></div>{box}<dl>{''.join(notes)}</dl><section><h1>{word()}</h1>{body}</section><div>Made with care</div></body></html>")
    return out


def test_templates_equal_brute_force(spark):
    rng = random.Random(3)
    hosts = {"a.org": nameless_pages(rng, 9), "b.org": nameless_pages(rng, 2), "c.org": nameless_pages(rng, 4) * 2}
    rows = [(i, f"http://{h}/{i}", p) for h, pages in hosts.items() for i, p in enumerate(pages)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {}
    for h, pages in hosts.items():
        fixed = plain_template([tuple((x[0], x[1]) for x in html.parse(p).items) for p in pages])
        for i, p in enumerate(pages):
            want[h, i] = " ".join(t for path, t, _ in html.parse(p).blocks if (path, t) not in fixed)
    for s in (html.Settings(), html.Settings(broadcast=1)):  # both ways to bring a host's template to its pages
        got = {(r.url.split("/")[2], r.page_id): r.text for r in html.extract(docs, s).collect()}
        assert got == want
    assert "Note one" in want["a.org", 0] and "Start" not in want["a.org", 0] and "Made with care" not in want["a.org", 0] and "Seen today" not in want["a.org", 1]
    assert "Start" in want["b.org", 0] and "Start" not in want["c.org", 5]


def test_repeated_articles_are_no_template(spark):
    """Near copies of an article on one host keep their text; a line that all its articles have goes."""
    same = "<article><h1>Title</h1><p>A text that three pages share, word by word.</p></article>"
    pages = [f"<body><ul><li>link {i}</li></ul>{same}</body>" for i in range(3)]
    other = [f"<body><article><p>Text number {i} is long and {i * 7919} its own</p><p>Share</p></article></body>" for i in range(5)]
    rows = [(i, "http://a.org/", p) for i, p in enumerate(pages)] + [(i + 10, "http://b.org/", p) for i, p in enumerate(other)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == got[2] == "Title A text that three pages share, word by word." and got[11] == "Text number 1 is long and 7919 its own"


def test_whole_articles(spark):
    """Title and lead stand beside the largest element of an article: both stay."""
    page = lambda i: f"<body><article><h1>T{i}</h1><div>Lead {i}</div><div class=body><p>{'long text ' * 50}{i}</p></div></article></body>"
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame([(i, "http://a.org/", page(i)) for i in range(6)], "page_id long, url string, html string")).collect()}
    assert got[3].startswith("T3 Lead 3 long text") and got[3].endswith("3")


def test_probes_follow_the_vectors():
    """Vectors in tight clusters need few cells, isotropic ones most."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(40, 16))
    middle /= np.linalg.norm(middle, axis=1)[:, None]
    tight = np.repeat(middle, 50, axis=0) + rng.normal(size=(2000, 16)) * 0.02
    shares = [ann.fit(x, 2000, ann.Settings(parts=4, codes=16)).probes for x in (tight, rng.normal(size=(2000, 16)))]
    assert shares[0] < 0.2 < shares[1] <= 1
