"""Every operator on small input: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from checks.compare import rows_of, views
from leaksieve.llm import (
    decontamination,
    exact_dedup,
    fm_index,
    html_text,
    language_id,
    line_dedup,
    packing,
    simhash_dedup,
    substring_dedup,
    tool_calls,
    url_filter,
)
from leaksieve.llm.graph import components
from leaksieve.llm.queries import QUERIES
from tests.conftest import SF

LONG = " ".join(f"w{k % 977}" for k in range(60_000))
TEXTS = [
    (5, "A b c d\nline two\n\n  End. "),
    (3, None),
    (4, ""),
    (7, LONG),
    (7, LONG),
    (None, "A b c d\nline two\n\n  End. "),
    (9, "a b c d\nline two\n\n  End. "),
    (10, "1234 ... \x0b\t"),
    (11, "été déjà vu " * 30),
    (12, "A b c d\nline two\n\n  End. "),
]
SCHEMA = "doc_id long, text string, lang string, h1 long, bucket int, words string, kept string"


def frame(spark, texts=TEXTS):
    rows = [(doc_id, text, "en", 1, 2, "x", None) for doc_id, text in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def made_texts(seed: int, n: int = 60) -> list[tuple[int, str]]:
    """Texts that share passages, lines and copies."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "Ne", "pu") for b in ("ra", "se", "ti,", "vo.", "xé")]
    passages = [" ".join(rng.choices(words, k=rng.randint(8, 40))) for _ in range(6)]
    out = []
    for doc_id in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(rng.randint(1, 4))]
        parts += rng.choices(passages, k=rng.randint(0, 3))
        rng.shuffle(parts)
        text = rng.choice(["\n", " ", "  \n"]).join(parts)
        out.append((doc_id, out[rng.randrange(len(out))][1] if out and rng.random() < 0.2 else text))
    return out


@pytest.mark.parametrize("name", [name for name, (_, sql) in QUERIES.items() if sql])
def test_query_and_its_twin(spark, name):
    query, sql = QUERIES[name]
    ours, theirs = query(spark, SF), views(SF).sql(sql)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours.columns, ours.collect()) == rows_of(theirs.columns, theirs.fetchall())


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {*QUERIES, "pipeline"} <= set(names)
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))


# ------------------------------------------------------------- substring dedup


def substrings_by_hand(texts, window):
    seen, out = {}, {}
    split = [(i, (t or "").encode().split()) for i, t in texts]
    for i, words in split:
        for p in range(len(words) - window + 1) if i is not None else ():
            key = tuple(words[p : p + window])
            seen[key] = min(seen.get(key, i), i)
    for i, words in split:
        gone = set()
        for p in range(len(words) - window + 1) if i is not None else ():
            if seen[tuple(words[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.setdefault(i, []).append((len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return {i: sorted(rows) for i, rows in out.items()}


@pytest.mark.parametrize("seed", range(2))
def test_substring_dedup(spark, monkeypatch, seed):
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", 5)
    texts = made_texts(seed) + [(100 + seed, None), (None, made_texts(seed)[0][1]), (200, LONG), (201, LONG)]
    got = defaultdict(list)
    for row in substring_dedup.dedup_substrings(frame(spark, texts)).collect():
        got[row.doc_id].append((row.n_words, row.n_removed, row.text))
    assert {i: sorted(rows) for i, rows in got.items()} == substrings_by_hand(texts, 13)


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.dedup_substrings(empty(spark)).collect() == []
    rows = substring_dedup.dedup_substrings(frame(spark)).collect()
    assert len(rows) == len(TEXTS) and all(r.n_removed == 0 for r in rows)


def test_fm_index_against_counting():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 6, 500), 0)
    starts = np.arange(488)
    index = fm_index.FMIndex(text, 13)
    _, low, high = index.search(starts, 5)
    for start in starts.tolist():
        same = [p for p in range(497) if (text[p : p + 5] == text[start : start + 5]).all()]
        if len(same) > 1:
            assert sorted(index.order[low[start] : high[start]].tolist()) == same


# ------------------------------------------------------------------ line dedup


def test_line_dedup_counts_whole_input(spark):
    texts = [(k, f"Shared {k % 3}\n\n Common LINE \nown {k}") for k in range(12)] + [(50, None), (51, "")]
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert rows[0].text == "Shared 0\n\nown 0" and (rows[0].n_lines, rows[0].n_dropped) == (4, 1)
    assert (rows[50].text, rows[50].n_lines, rows[51].n_dropped) == ("", 1, 0)
    assert line_dedup.dedup_lines(empty(spark)).collect() == []
    assert len(line_dedup.dedup_lines(frame(spark)).collect()) == len(TEXTS)


def test_line_runs_compact_and_skip_settled_keys(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fan=2)
    for _ in range(5):
        runs.add(spark.createDataFrame([(1, 1, 2), (2, 2, 1)], "h1 long, h2 long, docs long"))
    assert {(r.h1, r.docs) for r in runs.totals().collect()} == {(1, 4), (2, 3)}
    assert sum(len(level) for level in runs.levels) <= 3


# ----------------------------------------------------------------- exact dedup


def test_exact_dedup(spark):
    rows = exact_dedup.exact_dedup(frame(spark), exact_dedup.half(), keys_per_bucket=2).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in rows)
    groups = defaultdict(list)
    for doc_id, text in TEXTS:
        groups[text or ""].append(doc_id)
    want = []
    for doc_id, text in TEXTS:
        ids = groups[text or ""]
        keep = max(i for i in ids if i is not None)
        want.append((doc_id is None, doc_id or 0, keep, len(ids), doc_id == keep))
    assert got == sorted(want)
    assert exact_dedup.exact_dedup(empty(spark), exact_dedup.half()).collect() == []
    assert exact_dedup.exact_dedup(frame(spark), F.lit(None).cast("boolean")).where("historical").count() == 0


def test_perfect_hash_is_minimal_and_checked():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 62, (5000, 4)).astype(np.uint64)
    index = exact_dedup.PerfectHash(words)
    assert sorted(index.slots(words).tolist()) == list(range(5000))
    assert exact_dedup.PerfectHash(words[:0]).slots(words[:9]).tolist() == [-1] * 9


# --------------------------------------------------------------------- SimHash


def print_by_hand(text: str | None) -> int:
    words = [w.decode() for w in (text or "").encode().lower().split()]
    runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(run.encode(), 42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(texts):
    prints = [(i, print_by_hand(text)) for i, text in texts]
    root = {p: p for _, p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    distinct = sorted(root)
    for a in distinct:
        for b in distinct:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return Counter((i, p - (1 << 64) if p >> 63 else p, least.get(find(p))) for i, p in prints)


def test_simhash_components(spark):
    rng = random.Random(5)
    base = [f"word{rng.randrange(500)}" for _ in range(200)]
    near = []
    for k in range(40):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(200)] = f"new{k}"
        near.append((100 + k, " ".join(words)))
    texts = TEXTS + near
    rows = simhash_dedup.simhash_components(frame(spark, texts)).collect()
    assert Counter((r.doc_id, r.fp, r.component_id) for r in rows) == components_by_hand(texts)
    assert simhash_dedup.simhash_components(empty(spark)).collect() == []


def test_every_pair_within_the_radius_is_found_once(spark):
    rng = random.Random(6)
    prints = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(6):
            q = p
            for _ in range(rng.randrange(5)):
                q ^= 1 << rng.randrange(64)
            prints.add(q - (1 << 64) if q >> 63 else q)
    links = simhash_dedup.near_links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    want = Counter((a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert Counter((r.u, r.v) for r in links) == want


def test_components_of_chain_ring_and_star(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 102), (102, 100)] + [(200, 200 + k) for k in range(1, 9)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {**{k: 0 for k in range(31)}, **dict.fromkeys((100, 101, 102), 100), **{200 + k: 200 for k in range(9)}}


# ------------------------------------------------------------- decontamination


def test_decontamination_finds_near_windows_and_nothing_else(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    items = [(k, " ".join(word() for _ in range(60))) for k in range(5)] + [(5, None), (6, "..."), (7, "solo"), (8, items_short := "one two three")]
    del items_short
    filler = lambda n: " ".join(word() for _ in range(n))
    changed = items[1][1].split()
    changed[30] = "zzzz"
    broken = items[2][1].split()
    broken[::4] = ["yyyy"] * 15
    docs = [
        (1, filler(40) + " " + items[0][1].upper() + "! " + filler(20)),
        (2, filler(10) + "\n" + " ".join(changed) + filler(10)),
        (3, filler(10) + " " + " ".join(broken)),
        (4, filler(300)),
        (5, None),
        (6, ""),
        (7, "One, two: THREE"),
        (8, items[0][1]),
        (8, items[0][1]),
        (None, items[3][1] + " " + items[4][1]),
    ]
    benchmark = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, words string")
    found = decontamination.contaminated(frame(spark, docs), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 0), (2, 1), (7, 8), (8, 0), (None, 3), (None, 4)}
    assert {r.similarity for r in found if r.doc_id in (1, 7, 8)} == {1.0}
    assert decontamination.contaminated(empty(spark), benchmark).collect() == []
    assert decontamination.contaminated(frame(spark, docs), benchmark.limit(0)).collect() == []


def windows_by_hand(words, item, width=5):
    """(similarity, start) of every window of the item's words that is similar enough."""
    bag = lambda run: Counter(tuple(run[k : k + width]) for k in range(len(run) - width + 1))
    mine, out = bag(item), []
    for start in range(max(1, len(words) - len(item) + 1)):
        own = bag(words[start : start + len(item)])
        both = (own & mine).total()
        if both and both / (own.total() + mine.total() - both) >= 0.8:
            out.append((both / (own.total() + mine.total() - both), start))
    return out


def test_decontamination_tries_every_start(spark):
    rng = random.Random(88)
    made = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    items = {k: made(n) for k, n in enumerate((100, 100, 40, 57))} | {4: ["la"] * 30}
    docs = {
        cut: made(25) + item[cut:] + item[:cut] + made(25)
        for cut, item in [(20, items[0]), (30, items[0]), (50, items[1]), (70, items[1])]
    }
    docs |= {1: items[2][:39], 2: items[3][:-2], 3: made(3) + items[3] + made(2) + items[3], 4: ["la"] * 33, 5: items[2][:30]}
    docs |= {6: items[0][50:] + made(40) + items[0][:50], 7: items[2][20:] + items[2][:20]}
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    found = decontamination.contaminated(frame(spark, [(k, " ".join(w)) for k, w in docs.items()]), benchmark).collect()
    want = {}
    for doc_id, words in docs.items():
        for item_id, item in items.items():
            if windows := windows_by_hand(words, item):
                best = max(windows, key=lambda w: (w[0], -w[1]))
                want[doc_id, item_id] = (*best, len(windows))
    assert {(r.doc_id, r.item_id): (r.similarity, r.start, r.windows) for r in found} == want
    assert {(20, 0), (30, 0), (50, 1), (70, 1), (1, 2)} <= set(want)


def test_decontamination_query_against_every_start(spark):
    con, want = views(SF), {}
    words = lambda text: language_id.regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    grams = lambda run: {tuple(run[k : k + 5]) for k in range(len(run) - 4)}
    items = [(k, words(t)) for k, t in con.sql("SELECT item_id, text FROM benchmark").fetchall()]
    items = [(k, item, grams(item)) for k, item in items]
    for doc_id, text in con.sql("SELECT doc_id, text FROM documents").fetchall():
        own = words(text)
        held = grams(own)
        for item_id, item, theirs in items:
            if held & theirs and (windows := windows_by_hand(own, item)):
                best = max(windows, key=lambda w: (w[0], -w[1]))
                want[doc_id, item_id] = (*best, len(item), len(windows))
    rows = decontamination.op8_benchmark_decontamination(spark, SF).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_words, r.windows) for r in rows} == want and want


# ----------------------------------------------------------------- language ID


def test_code_lengths_against_counting():
    data = "abracadabra abracadabra"
    grams, n = np.unique(language_id._grams(np.frombuffer(data.encode(), np.uint8), 2), return_counts=True)
    trees = language_id.ContextTrees({"x": (grams, n)}, 2)

    def by_hand(text):
        padded, total = "\0\0" + data, 0.0
        for k, byte in enumerate(text):
            before = ("\0\0" + text)[k : k + 2]
            for order in (2, 1, 0):
                context = before[2 - order :]
                follow = Counter(padded[p + order] for p in range(2 - order, len(padded) - order) if padded[p : p + order] == context)
                size, kinds = sum(follow.values()), len(follow)
                if byte in follow:
                    total -= np.log2(follow[byte] / (size + kinds))
                    break
                if size:
                    total -= np.log2(kinds / (size + kinds))
            else:
                total += 8
        return total

    for text in ("abra", "cab zoo", "q"):
        assert trees.lengths([text.encode()])[0, 0] == pytest.approx(by_hand(text))


def test_language_id(spark):
    rows = language_id.op9_language_id(spark, SF).collect()
    truth = dict(views(SF).sql("SELECT doc_id, lang FROM documents").fetchall())
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    teachers = spark.createDataFrame([("en", "the cat and the dog"), ("fr", "le chat et le chien")], "lang string, text string")
    got = {r.doc_id: r for r in language_id.identify(frame(spark), teachers).collect()}
    assert (got[3].lang_pred, got[4].lang_pred, got[10].lang_pred) == ("und", "und", "und")
    assert got[10].score == 0.0 and all(0 <= r.score <= 1 for r in got.values())
    nobody = language_id.identify(frame(spark), teachers.limit(0)).collect()
    assert {r.lang_pred for r in nobody} == {"und"} and len(nobody) == len(TEXTS)
    assert language_id.identify(empty(spark), teachers).collect() == []


def test_copies_and_long_texts_change_no_sample(spark):
    texts = [("aa", f"text {k} of the first {k * k}") for k in range(20)] + [("bb", f"ein Text {k} {'ab' * k}") for k in range(60)]
    once = spark.createDataFrame(texts, "lang string, text string")
    often = spark.createDataFrame(texts[:20] * 100 + texts[20:] + [texts[33]] * 3000, "lang string, text string")
    few, many = (language_id.learn(table, 2, 20, 10_000) for table in (once, often))
    assert set(few) == set(many) == {"aa", "bb"}
    for lang in few:
        assert all((a == b).all() for a, b in zip(few[lang], many[lang], strict=True))
    assert few["aa"][1].sum() == sum(len(t) for lang, t in texts if lang == "aa")
    long = spark.createDataFrame([*texts[:20], *(("aa", f"{k}" * 20_000) for k in range(5))], "lang string, text string")
    grams, n = language_id.learn(long, 2, 400, 5000)["aa"]
    assert n.sum() == 5000
    assert set(few["aa"][0].tolist()) <= set(grams.tolist())


# --------------------------------------------------------------------- packing


def test_packing_round_trip(spark):
    odd = [(20, "I'll SEE the Éclair's 3.50€, ok...no way é İx <|endoftext|> \U0001f600 a.b,c."), (21, "Σίσυφος ΣΑΣ.")]
    texts = TEXTS + odd + made_texts(2)
    rows = packing.pack(frame(spark, texts), length=512, open_bins=4).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    want = Counter()
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 512)):
            want[doc_id, piece, at, np.array(ids[at : at + 512], "<u4").tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        ends = [0]
        for offset, length in sorted(spans):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 512
    assert packing.pack(empty(spark)).collect() == []


def test_the_fullest_bin_closes_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7, 4, 8, 3, 2)] == [(0, 0), (1, 0), (0, 6), (2, 0), (1, 7), (2, 8)]
    assert bins.put(5) == (3, 0) and bins.put(6) == (4, 0) and bins.put(7) == (5, 0)
    assert bins.put(5) == (3, 5) and bins.count == 1


# ------------------------------------------------------------------------ HTML

ARTICLE = (
    "<header><h1>Site</h1></header><div id='cookie-notice'><p>We use cookies.</p></div><main><article><h1>Title &amp; &eacute;</h1>"
    "<p>First <b>paragraph</b>\n with <a href=x>a link</a> in it.<p>Second<br>one<script>var x='<p>no</p>'</script><ul><li>item"
    "<li>other</ul><div class=ad><p>Buy</p></div><form><p>Sign up</p></form></article><section class='comments'><div><p>A long"
    " reader comment that is no part of it.</p></div></section></main><aside><p>Related</p></aside><footer>f</footer>"
)


def test_main_text(spark):
    pages = [(1, "u", ARTICLE), (1, "u", ARTICLE), (2, None, None), (None, "v", ""), (4, "w", "<p"), (5, "x", ARTICLE * 40)]
    table = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, text string")
    rows = html_text.extract_text(table).collect()
    want = "Title & é\nFirst paragraph with a link in it.\nSecond one\nitem\nother"
    by_id = {r.page_id: r for r in rows}
    assert len(rows) == 6 and by_id[1].text == want and by_id[1].n_chars == len(want)
    assert (by_id[2].text, by_id[None].n_chars) == ("", 0) and by_id[5].text == "\n".join([want] * 40)
    assert html_text.extract_text(table.limit(0)).collect() == []


STORY = "".join(f"<p>Paragraph {n} tells at some length what went on that day, and it {'goes on and on ' * 20}.</p>" for n in range(6))


@pytest.mark.parametrize("taught", [False, True])
@pytest.mark.parametrize("wrapper", [
    'class="layout has-sidebar"', 'id="content-with-sidebar"', 'class="main overflow-hidden"', 'aria-hidden="false"',
    'class="legal-news"', 'class="sidebar"', "data-state='hidden' title=hidden", 'class="hidden"',
])
def test_names_of_wrappers_do_not_decide(wrapper, taught):
    pages = [ARTICLE, f"<body><div><div><article><h1>Day</h1>{STORY}</article></div></div><footer><p>end</p></footer>"]
    counts = sum(html_text.page_counts(html_text.Page(page)) for page in pages).astype(float)
    model = html_text.TreeModel(counts if taught else counts * 0)
    rest = "<nav><a href=x>Home</a></nav><div class='cookie-notice'><p>We use cookies.</p></div><footer>end</footer>"
    want = html_text.TreeModel(counts * 0).text(f"<article>{STORY}</article>")
    assert len(want) > 2000
    assert model.text(f"<body><div {wrapper}>{STORY}</div>{rest}") == want
    assert model.text(f"<body><div {wrapper}><div><article>{STORY}</article></div></div>{rest}") == want
    aside = "<div class='related'><article><p>A teaser of another one.</p></article></div><p hidden>Not seen at all here.</p>"
    assert model.text(f"<body><div {wrapper}><main>{STORY}</main>{aside}</div>{rest}") == want


def test_marginals_are_those_of_all_assignments():
    model = html_text.TreeModel(html_text.page_counts(html_text.Page(ARTICLE)).astype(float))
    page = html_text.Page("<div><p>Some text here, enough of it.</p><ul><li><a href=x>y</a></ul></div><p>z</p>")
    n = len(page.parent)
    own = np.ones((n, 2))
    for column, shares in zip(page.features().T, model.unary, strict=True):
        own *= shares.T[column]
    total = np.zeros((n, 2))
    for code in range(1 << n):
        state = [code >> k & 1 for k in range(n)]
        weight = (0.95, 0.05)[state[0]] * np.prod([own[k, state[k]] for k in range(n)])
        for k in range(1, n):
            weight *= model.steps[page.kind[page.parent[k]]][state[page.parent[k]], state[k]]
        total[range(n), state] += weight
    assert model.marginals(page) == pytest.approx(total[:, 1] / total.sum(axis=1))


# ------------------------------------------------------------------------ URLs


def test_url_rules_and_words(spark):
    urls = ["http://A.Example.org/es/1?q", "https://x.org", "https://x.org/", "no url", None, "ftp://b.com/de/x#y", "http://com/fr/"]
    urls += ["https://freecasinobets.net/win/now", "https://freecasinobets.net/win/later", "https://catdog.net/a"] + ["https://catdog.net/b?c"] * 9
    words = "<p>free cat dog dog cat win</p>" * 5
    pages = spark.createDataFrame([(k, u, words, "h") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    rows = {r.page_id: r for r in url_filter.judge(pages, url_filter.RULES).collect()}
    assert len(rows) == len(urls)
    assert (rows[0].host, rows[0].path, rows[0].rule, rows[0].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (rows[1].rule, rows[1].path, rows[2].rule, rows[3].host, rows[4].path) == (None, "", "org/", "", "")
    assert (rows[5].rule, rows[5].path, rows[6].rule) == ("com/de/", "/de/x", "com/fr/")
    assert rows[7].words == ["free", "casino", "bets", "net"] and rows[7].verdict == rows[8].verdict == "block"
    assert rows[9].words == ["cat", "dog", "net"] and rows[9].verdict == rows[10].verdict == "allow"
    assert url_filter.judge(pages.limit(0), url_filter.RULES).collect() == []


def test_url_query_keeps_every_page(spark):
    rows = url_filter.op6_url_filters(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert {r.verdict for r in rows} == {"allow", "block"}


# ------------------------------------------------------------------ tool calls


def test_calls_are_linked_and_ordered(spark):
    calls = [
        (1, "c", 5, "f", '{"b": 1, "a": "é"}', ["a", "b"]),
        (1, "b", 2, "f", '{"a": 2}', ["a"]),
        (1, "a", 1, "f", "not json", None),
        (1, "r", 3, "g", "[]", ["s"]),
        (1, "s", 4, "g", "{}", ["r"]),
        (1, "m", 6, "g", "{}", ["gone"]),
        (2, "a", 1, None, None, []),
        (2, "a", 1, None, None, []),
        (2, None, 9, "f", "{}", []),
    ]
    results = [(1, "c", 9, "late"), (1, "c", 8, "first"), (1, "x", 3, "lost"), (2, "b", None, None), (None, "a", 1, "no conversation")]
    made = spark.createDataFrame(calls, "conv_id long, call_id string, position long, name string, arguments string, needs array<string>")
    got = spark.createDataFrame(results, "conv_id long, call_id string, position long, content string")
    schemas = {"f": {"type": "object", "required": ["a"], "properties": {"a": {"type": "string"}}}}
    rows = {(r.conv_id, r.call_id): r for r in tool_calls.link_calls(made, got, schemas).collect()}
    assert [rows[1, k].level for k in "abcrsm"] == [0, 1, 2, None, None, None]
    assert rows[1, "c"].json == (
        '{"arguments":{"a":"é","b":1},"id":"c","level":2,"name":"f","needs":["a","b"],"result":"first","status":"linked"}'
    )
    assert (rows[1, "c"].n_results, rows[1, "c"].valid, rows[1, "a"].errors) == (2, True, ["$: not JSON"])
    assert rows[1, "b"].errors == ["$.a: not string"] and rows[1, "r"].errors == ["$: not object"]
    assert rows[1, "x"].status == rows[2, "b"].status == "orphan" and rows[1, "m"].status == "blocked"
    assert rows[2, "a"].status == "unanswered" and rows[2, None].status == "no_id"
    assert tool_calls.link_calls(made.limit(0), got.limit(0), schemas).collect() == []


def test_op1_levels_do_not_depend_on_blocks(spark):
    """A chain over many blocks, random needs, crowded and null positions, a ring and what hangs on it."""
    draw = random.Random(3)
    needs = {f"c{k}": {f"c{k - 1}"} if k % 40 else set() for k in range(120)}
    needs |= {f"r{k}": {f"r{draw.randrange(k)}" for _ in range(draw.randrange(3)) if k} for k in range(200)}
    needs |= {"ring1": {"ring2", "c3"}, "ring2": {"ring1"}, "behind": {"ring1", "c0"}, "self": {"self"}, "lost": {"nowhere"}}
    expected = {}
    while fresh := {c: 1 + max((expected[n] for n in ns), default=-1) for c, ns in needs.items() if c not in expected and ns <= expected.keys()}:
        expected |= fresh

    def position(call):
        return None if call[0] == "b" else int(call[1:]) if call[0] == "c" else 5

    calls = spark.createDataFrame([(v, c, position(c)) for v in (1, 2) for c in needs], "conv_id long, call_id string, position long")
    edges = [(v, c, n) for v in (1, 2) for c, ns in needs.items() for n in ns]
    wanted = spark.createDataFrame(edges, "conv_id long, call_id string, need string")
    for block in (16, 50_000):
        got = {(r.conv_id, r.call_id): r.level for r in tool_calls.levels(wanted, calls, block).collect()}
        assert got == {(v, c): level for v in (1, 2) for c, level in expected.items()}


def test_tool_call_query_against_a_walk(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    role, text = ({(t.conv_id, t.turn): t[k] for t in turns} for k in ("role", "text"))
    rows = tool_calls.op1_tool_calls(spark, SF).collect()
    assert {(r.conv_id, int(r.call_id[5:])) for r in rows if r.status != "orphan"} == {k for k in role if role[k] != "assistant"}
    for r in rows:
        turn, entry = int(r.call_id[5:]), json.loads(r.json)
        answered = role.get((r.conv_id, turn + 1)) == "assistant"
        assert (r.status == "linked") == (answered and r.status != "orphan") and tool_calls.canonical(entry) == r.json
        assert entry.get("result") == (text[r.conv_id, turn + 1] if answered else None)
        level, at = 0, turn
        while role.get((r.conv_id, at)) == "user" and (role.get((r.conv_id, at - 2)) in ("user", "system") or role.get((r.conv_id, at - 1)) == "system"):
            at, level = (at - 2 if role.get((r.conv_id, at - 2)) in ("user", "system") else at - 1), level + 1
        assert r.status == "orphan" or r.level == level


def test_digests_are_those_of_the_kept_text(spark):
    for row in line_dedup.op5_line_dedup(spark, SF).limit(3).collect():
        assert len(row.kept_sha256) == 64
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
