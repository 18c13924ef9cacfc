"""The text operators against brute force on small fixtures, with nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from swathe.llm import bm25, decontam, html_text, langid, pieces, secrets, simhash, toxicity, url_rules, warc

from conftest_llm import docs

WORDS = "the of and stone river mountain light green walks slowly under seven bright old houses while birds sing near quiet water today".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# --- 1 WARC


def brute_warc(pages):
    by = defaultdict(list)
    for i, _, h in pages:
        by[(h or "").encode()].append(i)
    out = []
    for i, _, h in pages:
        p = (h or "").encode()
        first = max((x for x in by[p] if x is not None), default=None)
        again = len(p) >= 1000 and first is not None and (i is None or i < first)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_warc(spark, tables, extra):
    big, odd = "é\r\n\r\nWARC/1.1\r\n" * 100, "x" * 999
    pages = [(1, "http://a/x", big), (2, "http://b/\r\ny", big), (5, None, big), (None, "http://c", big), (5, "http://a/x", big), (3, "", odd), (4, "u", odd), (7, "v", None), (8, "v", ""), (9, "w", "x" * 1000)]
    got = rows(warc.op1_warc(spark, tables(extra, pages=pages)))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute_warc(pages)
    assert all(r["digest_ok"] and r["has_request"] for r in got)


def test_warc_repeated_ids(spark, tables):
    pages = [(1, "u", "x" * 1500), (1, "u", "small"), (1, "u", "y" * 1200), (2, "u", "x" * 1500), (9, "u", "y" * 1200), (9, "u", "y" * 1200), (None, "u", "z" * 1500), (None, "u", "z" * 1500), (None, "v", "x" * 1500), (1 << 60, "u", "w" * 70_000), (1 << 60 | 1, "u", "w" * 70_000)]
    folder = tables(pages=pages)
    got = rows(warc.op1_warc(spark, folder))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute_warc(pages)
    assert all(r["digest_ok"] and r["has_request"] for r in got)
    path = folder + "/archives"
    warc.write_archives(spark.read.parquet(folder + "/pages.parquet"), path, file_bytes=10_000)
    records = warc.read_archives(spark, path).collect()
    assert len({r.record_id for r in records}) == len(records) == 3 * len(pages)
    responses = {r.record_id: r for r in records if r.type == "response"}
    assert all(responses[r.refers_to].digest == r.digest for r in records if r.type == "revisit")


def test_warc_empty(spark, tables):
    assert warc.op1_warc(spark, tables(pages=[])).count() == 0


def test_transactions_by_chain_and_orphans(spark):
    schema = warc.RECORDS
    rec = lambda i, kind, to, f=None: (i, kind, to, "u", None, None, 0, "", f, None)
    records = spark.createDataFrame([rec("r1", "response", ["q1"]), rec("q1", "request", []), rec("m1", "metadata", ["q2"], {"a": "b"}), rec("q2", "request", ["r2"]), rec("r2", "response", []), rec("m3", "metadata", ["gone"])], schema)
    got = {(r["record"] or {}).get("record_id"): r for r in rows(warc.assemble(records))}
    assert got["r1"]["request"]["record_id"] == "q1" and got["r1"]["n_metadata"] == 0
    assert got["r2"]["request"]["record_id"] == "q2" and got["r2"]["metadata"]["fields"] == {"a": "b"}
    assert got[None]["metadata"]["record_id"] == "m3"


def test_warc_parser_reads_members():
    import gzip

    record = lambda i, body: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    parts = [record(k, b) for k, b in enumerate((b"", b"WARC/1.0\r\n", bytes(range(256))))]
    for data in (b"".join(parts), gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))):
        assert [r[-1] for r in warc.parse(data)] == [b"", b"WARC/1.0\r\n", bytes(range(256))]


# --- 2 SentencePiece


@pytest.fixture(scope="module")
def vocab():
    return pieces.load()


def all_segmentations(seg, word):
    into = seg._edges(word)

    def ways(end):
        if end == 0:
            return [(0.0, ())]
        return [(s0 + s, ids0 + ids) for a, s, ids in into[end] for s0, ids0 in ways(a)]

    return sorted(ways(len(word)), key=lambda w: (-w[0], len(w[1])))


@pytest.mark.parametrize("n", [1, 2, 5])
def test_nbest_by_enumeration(vocab, n):
    seg = pieces.Segmenter(vocab, n)
    for text in ("a", "the", "hi there", "of the end", "ab  cd", "éa x", "\u20ac\U0001f600", " x ", "aaaa"):
        whole = (" " + text).replace(" ", pieces.SPACE)
        want = [round(s, 6) for s, _ in all_segmentations(seg, whole)][:n]
        lists, found = seg.encode(text)
        assert [round(s, 6) for s, _ in found] == want, text
        ids = [seg.ids(lists, p) for _, p in found]
        assert len(set(ids)) == len(ids)
        assert all(seg.decode(i) == text for i in ids)


def test_words_equal_the_search_over_the_whole(vocab):
    seg = pieces.Segmenter(vocab, 3)
    r = random.Random(3)
    words = ["".join(r.choice("thernioséß.,\n") for _ in range(r.randint(1, 40))) for _ in range(300)] + ["a" * 700, "ab" * 400]
    for w in words:
        lists, found = seg.encode(w)
        assert abs(found[0][0] - seg.nbest(pieces.SPACE + w)[0][0]) < 1e-3
        assert found[0][0] >= found[-1][0] and seg.decode(seg.ids(lists, {})) == w


def test_pieces_query(spark, tables):
    texts = [None, "", prose(1, 30), prose(1, 30), "\n\t x\u2581y", "z" * 3000, prose(2, 4000)]
    got = {r["doc_id"]: r for r in rows(pieces.op2_pieces(spark, tables(True, documents=docs(texts))))}
    assert len(got) == 7 and all(r["decoded"] for r in got.values())
    assert got[0]["n_pieces"] == got[1]["n_pieces"] == 0 and got[2]["sha256"] == got[3]["sha256"]
    assert all(r["nbest"][0]["sha256"] == r["sha256"] for r in got.values())
    assert pieces.op2_pieces(spark, tables(documents=[])).count() == 0


def test_pieces_query_by_enumeration(spark, tables, vocab):
    seg = pieces.Segmenter(vocab, pieces.NBEST)
    texts = ["the end", "a", "of it", "é x", "hi there", None, "of it"]
    got = {r["doc_id"]: r for r in rows(pieces.op2_pieces(spark, tables(documents=docs(texts))))}
    for i, text in enumerate(texts):
        ways = all_segmentations(seg, (" " + text).replace(" ", pieces.SPACE)) if text else [(0.0, ())]
        assert [round(x["score"], 6) for x in got[i]["nbest"]] == [round(w, 6) for w, _ in ways[: pieces.NBEST]]
        digest = lambda ids: hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
        by_digest = {digest(ids): (round(w, 6), len(ids)) for w, ids in ways}
        assert all(by_digest[x["sha256"]] == (round(x["score"], 6), x["n_pieces"]) for x in got[i]["nbest"])
        assert len({x["sha256"] for x in got[i]["nbest"]}) == len(got[i]["nbest"]) and got[i]["n_pieces"] == got[i]["nbest"][0]["n_pieces"]


def test_models_that_cross_words_are_refused(vocab, monkeypatch):
    import sentencepiece

    class Model:
        def __init__(self, **_):
            pass

        get_piece_size = lambda self: 1
        is_byte = is_control = is_unknown = is_unused = lambda self, i: False
        id_to_piece = lambda self, i: "of" + pieces.SPACE + "the"
        get_score = lambda self, i: -1.0

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Model)
    with pytest.raises(ValueError, match="cross"):
        pieces.load("any")


# --- 3 BM25


def brute_bm25(documents, k):
    bags = [(i, Counter(bm25.WORD.findall((t or "").lower()))) for i, t, *_ in documents]
    n, mean = len(bags), sum(sum(b.values()) for _, b in bags) / len(bags)
    df = Counter(w for _, b in bags for w in b)
    out = set()
    for q, terms in {(i, frozenset(b)) for i, b in bags if i is not None and i % 20 == 0}:
        scored = []
        for i, b in bags:
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w in terms if w in b)
            if s > 0:
                scored.append(round(s, 5))
        out |= {(q, r + 1, s) for r, s in enumerate(sorted(scored, reverse=True)[:k])}
    return out


def test_bm25(spark, tables):
    texts = [prose(s, 5 + s % 60) for s in range(150)] + [None, "", prose(0, 5), prose(0, 5)]
    documents = docs(texts) + [(None, prose(20, 25), "en", "s", 1)]
    got = rows(bm25.search(spark.read.parquet(tables(True, documents=documents) + "/documents.parquet"), bm25.F.col("query") % 20 == 0, query_block=3))
    assert {(r["query"], r["rank"], round(r["score"], 5)) for r in got} == brute_bm25(documents, 10)
    assert bm25.op3_bm25(spark, tables(documents=[])).count() == 0


def test_bm25_over_many_shards(spark, tables, monkeypatch):
    """Shards of a few documents, many in a partition: files hold whole ones, and rounds and merges give the same."""
    monkeypatch.setattr(bm25, "SHARD_DOCS", 4)
    monkeypatch.setattr(bm25, "SEED_SHARE", 3)
    texts = [prose(s % 90, 5 + s % 40) for s in range(160)]
    documents = docs(texts)
    got = rows(bm25.search(spark.read.parquet(tables(documents=documents) + "/documents.parquet"), bm25.F.col("query") % 20 == 0, query_block=5))
    assert {(r["query"], r["rank"], round(r["score"], 5)) for r in got} == brute_bm25(documents, 10)


def _shard(r, n, topics=1):
    """Bags of zipf words, each topic with words of its own; repeats among them."""
    terms = [np.unique(r.zipf(1.3, 60) % 400) + 1000 * (d % topics) for d in range(n)]
    terms[5] = terms[5 + topics]
    tfs = [np.ones(len(t), np.int32) if d == 5 else r.integers(1, 5, len(t)).astype(np.int32) for d, t in enumerate(terms)]
    tfs[5 + topics] = tfs[5]
    lengths = np.array([t.sum() for t in tfs], np.int64)
    made = bm25.build([str(d) for d in range(n)], lengths, np.cumsum([len(t) for t in terms]), np.concatenate(terms).astype(np.int64), np.concatenate(tfs), 60.0)
    return bm25.unpack(b"".join(bm25.pack(made))), terms, tfs, lengths


@pytest.mark.parametrize("least", [0.0, 0.9])
def test_bm25_pruning_is_exact(least):
    r = np.random.default_rng(2)
    arrays, terms, tfs, lengths = _shard(r, 700)
    shard, exact = bm25.Shard(arrays, 60.0), bm25.Shard(arrays, 60.0, exact=True)
    asked = [terms[i] for i in range(300)]
    of_term = r.random(400) + 0.01
    weights = [of_term[t] for t in asked]
    q = bm25.Queries(list(range(300)), np.cumsum([len(t) for t in asked]), np.concatenate(asked), np.concatenate(weights))
    want = []
    for t, w in zip(asked, weights, strict=True):
        scores = []
        for d in range(700):
            both, x, y = np.intersect1d(t, terms[d], return_indices=True)
            scores.append((-round(float((w[x] * bm25.impacts(tfs[d][y], lengths[d : d + 1], np.zeros(len(both), int), 60.0)).sum()), 9), d))
        want.append(sorted(x for x in scores if x[0] < 0)[:10])
    q.least = np.array([least * -x[9][0] for x in want])
    pairs = shard.search(q, 10)
    assert len(pairs[0]) < 300 * 40
    order = np.lexsort((pairs[1], pairs[0]))
    got = defaultdict(list)
    for i, d, x in zip(*map(np.ndarray.tolist, exact.best(q, pairs[0][order], pairs[1][order], 10)), strict=True):
        got[i].append((x, exact.ids[d]))
    for i in range(300):
        assert [d for _, d in got[i]] == [str(d) for _, d in want[i]]
        assert np.allclose([s for s, _ in got[i]], [-s for s, _ in want[i]])


def test_bm25_skips_blocks():
    r = np.random.default_rng(4)
    arrays, terms, *_ = _shard(r, 2400, topics=6)
    shard = bm25.Shard(arrays, 60.0)
    asked = [terms[i] for i in range(768)]
    q = bm25.Queries(list(range(768)), np.cumsum([len(t) for t in asked]), np.concatenate(asked), np.ones(sum(map(len, asked))))
    shard.search(q, 10)
    assert 0 < shard.active <= shard.scored < 0.5 * shard.pairs


# --- 4 HTML


PAGE = "<html><head><title>t</title><style>p{}</style></head><body><header>top</header><nav><ul><li><a href='/a'>menu</a></ul></nav>{promo}<div class='ad'>buy</div><article><h1>Title &amp; {n}</h1><p><b>First  line {n}<br>goes\n on<p>Second {n}{more}</article><div id=comments><p>reader</p></div><aside>side</aside><form>f</form><footer>&copy; x</footer><script>var t='</p>';</script></body></html>"


def test_html_extraction(spark, tables):
    promo = "<div><p>Join our club</p></div>"
    pages = [(i, f"https://h.example/{i}", PAGE.replace("{promo}", promo).replace("{n}", f"part {i} of it").replace("{more}", "<p>Ever the same</p>")) for i in range(8)]
    pages += [(20, None, None), (21, "x", ""), (22, "https://o.example/", "plain <b>text"), (22, "https://o.example/", "plain <b>text"), (23, "https://o.example", "<div>One<p>two<li>three&nbsp;x<!-- no --><td>four")]
    got = {r["page_id"]: r for r in rows(html_text.op4_html_text(spark, tables(True, pages=pages)))}
    for i in range(8):
        assert got[i]["text"] == f"Title & part {i} of it\nFirst line part {i} of it goes on\nSecond part {i} of it"
    assert got[20]["text"] == got[21]["text"] == "" and got[20]["n_chars"] == 0
    assert got[22]["text"] == "plain text" and got[23]["text"] == "One\ntwo\nthree x\nfour"
    assert html_text.op4_html_text(spark, tables(pages=[])).count() == 0


def test_copied_articles_stay(spark, tables):
    body = "<body><nav>m</nav><article><p>Whole article that was copied</p><p>with two parts</p></article></body>"
    got = rows(html_text.op4_html_text(spark, tables(pages=[(i, "http://c.example/", body) for i in range(9)])))
    assert {r["text"] for r in got} == {"Whole article that was copied\nwith two parts"}


def test_copied_plain_pages_stay(spark, tables):
    body = "<body><div><p>Whole text that was copied</p><p>with two parts</p></div></body>"
    own = [(i, "http://p.example/", f"<body><div><p>Only here number {i}</p><p>and some more {i}</p></div></body>") for i in range(20, 24)]
    got = rows(html_text.op4_html_text(spark, tables(pages=[(i, "http://p.example/", body) for i in range(9)] + own)))
    assert {r["text"] for r in got if r["page_id"] < 20} == {"Whole text that was copied\nwith two parts"}


def test_templates_are_judged_one_by_one(spark, tables):
    page = lambda i, parts: "<article>" + "".join(f"<p>Paragraph {k} of text number {i} is here</p>" for k in range(2)) + parts + "</article>"
    both = "<p>Join our club now</p><p>Read more of this site</p>"
    pages = [(i, "http://t.example/", page(i, both if i < 8 else "")) for i in range(24)]
    for r in rows(html_text.op4_html_text(spark, tables(pages=pages))):
        assert r["text"] == "\n".join(f"Paragraph {k} of text number {r['page_id']} is here" for k in range(2))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><div class='content has-sidebar'><p>The story</p></div><div class=sidebar>side</div></body>", "The story"),
        ("<article class='post no-comments'><p>The story</p></article><section id=comments>reader</section>", "The story"),
        ("<article><div class='entry-header'><h1>Title</h1></div><p>The story</p><div class=share-buttons>Share</div></article>", "Title\nThe story"),
        ("<main><article class=teaser><p>Short</p></article><h1>Head</h1><p>The long story beside the teaser stands here</p></main>", "Short\nHead\nThe long story beside the teaser stands here"),
        ("<article><h1>Head</h1><p>The long story stands here in full</p></article><article><p>More</p></article>", "Head\nThe long story stands here in full"),
        ("<form id=page><nav>menu</nav><article><p>The story</p></article><footer>foot</footer></form>", "The story"),
        ("<div class='layout sidebar-left'><article><p>The story</p></article><div id=sidebar>side</div></div>", "The story"),
        ("<article><p>Story</p><div class=comments><article class=comment-body><p>A reader writes far more than the author of this story did</p></article></div></article>", "Story"),
        ("<div><h1>Head</h1><p>The story</p><div class='cookie-notice'>We use them</div><div class=topMenu>a b</div></div>", "Head\nThe story"),
        ("<article><p>A <span class=alert>red</span> word</p><div class=alert>Notice</div></article>", "A red word"),
        ("<div class='promoBox'><p>All there is</p></div>", "All there is"),
        ("<article><p>x</p></article>" + "<p>" * 3000, "x"),
        ("<article>" + "<div><p>long text here</p>" * 2000 + "</article>", "\n".join(["long text here"] * 2000)),
    ],
)
def test_content_by_names_and_mass(page, want):
    assert html_text.extract(page, set()) == want


def brute_text(pages, least=5, share=0.1):
    """The extraction with the templates counted by plain dictionaries."""
    seen = defaultdict(set)
    for _, url, page in pages:
        if host := html_text.host_of(url):
            nodes, items = html_text.parse(page or "")
            for h, x in html_text.contexts(nodes, items, html_text.kept(nodes, items)):
                seen[host, h].add(x)
    known = defaultdict(set)
    for (host, h), own in seen.items():
        if h and len(own) >= max(least, share * len(seen[host, 0])):
            known[host].add(h)
    return sorted(((i, html_text.extract(p or "", known[html_text.host_of(u)])) for i, u, p in pages), key=str)


def test_html_query_by_brute_force(spark, tables):
    r = random.Random(41)
    pages = []
    for i in range(120):
        host = r.choice(["a.example", "b.example", "c.example"])
        parts = [f"<p>{prose(r.randrange(10**6), 12)}</p>" for _ in range(r.randint(1, 4))]
        for k in range(3):
            if r.random() < (0.9, 0.3, 0.05)[k]:
                parts.insert(r.randrange(len(parts) + 1), f"<div><p>Common part {k} of {host}</p></div>")
        pages.append((i, f"http://{host.upper()}/{i}", "<body><nav>m</nav>" + r.choice(["<article>{}</article>", "<main>{}</main>", "<div>{}</div>"]).format("".join(parts))))
    pages += [(7, pages[7][1], pages[7][2]), (None, pages[8][1], pages[8][2]), (500, "x://", None)]
    got = rows(html_text.op4_html_text(spark, tables(pages=pages)))
    assert sorted(((x["page_id"], x["text"]) for x in got), key=str) == brute_text(pages)


def test_hosts_in_parts_give_the_same(spark, tables, monkeypatch):
    promo = "<div><p>Join our club</p></div>"
    pages = [(i, "https://h.example/", PAGE.replace("{promo}", promo).replace("{n}", f"part {i} of it").replace("{more}", "<p>Ever the same</p>")) for i in range(12)] + [(None, None, "<p>x</p>")]
    folder = tables(pages=pages)
    want = sorted((str(r["page_id"]), r["text"]) for r in rows(html_text.op4_html_text(spark, folder)))
    monkeypatch.setattr(html_text, "small", lambda df, most: df)
    assert sorted((str(r["page_id"]), r["text"]) for r in rows(html_text.op4_html_text(spark, folder))) == want
    assert not any("Ever" in t for _, t in want)


def test_html_depth_and_rubbish():
    deep = "<div>" * 20000 + "x" + "</div>" * 3
    assert html_text.extract(deep, set()) == "x"
    assert html_text.extract("a < b <c d=\"e>f\">g</c> <", set()) == "a < b g <"
    assert html_text.extract("<p title='unclosed>text</p>", set()) == "text"


# --- 5 SimHash


def brute_fingerprint(text, width=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps, budget=4):
    group = list(range(len(ids)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= budget:
            group[top(j)] = top(i)
    out = {}
    for i in range(len(ids)):
        own = [ids[k] for k in range(len(ids)) if top(k) == top(i) and ids[k] is not None]
        out[i] = min(own, default=None)
    return out


def simhash_texts():
    base = prose(9, 400).split()
    texts = [None, "", " \t\n", "One", "ONE", "one two three", "É é É é", "É é É é x"]
    for k in range(40):
        words = list(base)
        words[k * 7 % 400] = f"changed{k}"
        texts.append(" ".join(words))
    return texts + [prose(s, 20 + s) for s in range(60)] + [" ".join(base)] * 5


@pytest.mark.parametrize("extra", [False, True])
def test_simhash(spark, tables, extra):
    documents = docs(simhash_texts()) + [(None, "One", "en", "s", 3), (3, "One", "en", "s", 3)]
    fps = [brute_fingerprint(t) for _, t, *_ in documents]
    comp = brute_components([d[0] for d in documents], fps)
    want = sorted(((d[0], f"{f:016x}", comp[i]) for i, (d, f) in enumerate(zip(documents, fps, strict=True))), key=str)
    got = rows(simhash.op5_simhash(spark, tables(extra, documents=documents)))
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want


def test_simhash_empty(spark, tables):
    assert simhash.op5_simhash(spark, tables(documents=[])).count() == 0


def test_trie_join_equals_all_pairs():
    r = np.random.default_rng(4)
    x = r.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)
    for _ in range(3):
        x = np.concatenate((x, x ^ (np.uint64(1) << r.integers(0, 64, len(x)).astype(np.uint64))))
    a, b = np.unique(x[:2000]), np.unique(x[1500:])
    for budget in (0, 3, 4):
        own = {(int(i), int(j)) for p, q in simhash.trie_join(a, None, budget, chunk=256) for i, j in zip(p, q, strict=True)}
        near = np.bitwise_count(a[:, None] ^ a[None, :]) <= budget
        assert own == {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.where(near)), strict=True) if i < j}
        two = {(int(i), int(j)) for p, q in simhash.trie_join(a, b, budget) for i, j in zip(p, q, strict=True)}
        assert two == set(zip(*map(np.ndarray.tolist, np.where(np.bitwise_count(a[:, None] ^ b[None, :]) <= budget)), strict=True))


def test_chain_becomes_one_component(spark):
    n = 70
    values = [int(("1" * (3 * k)).rjust(64, "0")[-64:], 2) for k in range(22)] + [1 << 63 | v for v in range(n - 22)]
    edges = spark.createDataFrame([(k + 1, k) for k in range(n)] + [(200, 201)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {k + 1: 0 for k in range(n)} | {201: 200} and len(values) == n


@pytest.mark.parametrize("most", [3, 1000])
def test_links_equal_all_pairs(spark, most, monkeypatch):
    """Groups of any size, dealt again and again or not, and batches cut anywhere give the same components."""
    monkeypatch.setattr(simhash, "BATCH", 50)
    r = np.random.default_rng(9)
    x = r.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2)
    for _ in range(3):
        flips = sum(np.uint64(1) << r.integers(0, 64, len(x)).astype(np.uint64) for _ in range(2))
        x = np.concatenate((x, x ^ flips))
    x = np.unique(np.concatenate((x, np.array([0, (1 << 64) - 1, 1 << 63], np.uint64))))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    root = {row.node: row.root for row in simhash.components(simhash.links(df, 4, most)).collect()}
    got, want = defaultdict(set), defaultdict(set)
    comp = brute_components(list(range(len(x))), [int(v) for v in x])
    for i, v in enumerate(x.view(np.int64).tolist()):
        got[root.get(v, v)].add(i)
        want[comp[i]].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_blocks_part_all_bits():
    for mask in (simhash.MASK, 0xFFFF00FF, 0b1011, 0):
        parts = simhash.blocks(mask, 5)
        assert sum(parts) == mask and len(parts) == 5


def test_large_ids_beside_nulls(spark, tables):
    """One null id in a batch must leave the others exact."""
    big = 1152921504606846977
    texts = [LANGS["en"] + " idiot", LANGS["en"], prose(5, 30)]
    documents = [(big, texts[0], "en", "s", 1), (None, texts[1], "en", "s", 1), (big + 2, texts[2], "en", "s", 1), (20 * 57646075230342349, texts[0], "en", "s", 1)]
    ids = sorted(str(d[0]) for d in documents)
    folder = tables(documents=documents, labels=[(big, 1, 1)], benchmark=[(big, prose(5, 30)), (None, texts[1])])
    read = spark.read.parquet(folder + "/documents.parquet")
    for got in (pieces.op2_pieces(spark, folder), langid.op8_language(spark, folder), toxicity.op10_toxicity(spark, folder), simhash.op5_simhash(spark, folder), secrets.op6_secrets(spark, folder)):
        assert sorted(str(x.doc_id) for x in got.collect()) == ids
    assert sorted(str(x.id) for x in bm25.bags(read, "doc_id", "text").collect()) == ids
    found = {(x.doc_id, x.item_id) for x in decontam.op9_decontamination(spark, folder).collect()}
    assert {(big + 2, big), (None, None)} <= found
    assert {x.doc_id for x in bm25.search(read, bm25.F.col("query") % 20 == 0).select(bm25.F.col("id").alias("doc_id")).collect()} == {big, None, big + 2, 20 * 57646075230342349} - ({big + 2} if not set(texts[2].split()) & set(texts[0].split()) else set())


def test_long_texts_are_read_to_their_ends(spark, tables):
    long = prose(77, 150_000)
    item = prose(901, 25)
    text = long + " " + item + " you idiot idiot idiot token=abcdefghijkl012345"
    toxic, labels = toxic_docs()
    documents = [*toxic, (5000, text, "en", "src1", 1), (5001, long, "en", "src1", 1)]
    folder = tables(documents=documents, labels=labels, benchmark=[(1, item)], pages=[(1, "http://a/", f"<article><p>{long}</p><p>The end</p></article>"), (2, "http://a/", "<p>short</p>")])
    at = len(text) - len("token=abcdefghijkl012345")
    assert {(r["doc_id"], r["start"]) for r in rows(decontam.op9_decontamination(spark, folder))} == {(5000, len(long) + 1)}
    assert {r["doc_id"]: r["spans"] for r in rows(secrets.op6_secrets(spark, folder)) if r["doc_id"] >= 5000} == {5000: f"assign:{at}:{len(text)}", 5001: ""}
    score = {r["doc_id"]: r["score"] for r in rows(toxicity.op10_toxicity(spark, folder)) if r["doc_id"] >= 5000}
    assert score[5000] > score[5001]
    fp = {r["doc_id"]: r["fingerprint"] for r in rows(simhash.op5_simhash(spark, folder)) if r["doc_id"] >= 5000}
    assert fp[5000] == f"{brute_fingerprint(text):016x}"
    assert all(r["decoded"] for r in rows(pieces.op2_pieces(spark, folder)))
    assert {r["doc_id"] for r in rows(langid.op8_language(spark, folder)) if r["rejected"]} == set()
    page = {r["page_id"]: r for r in rows(html_text.op4_html_text(spark, folder))}
    assert page[1]["text"] == " ".join(long.split()) + "\nThe end" and page[1]["n_chars"] == len(page[1]["text"])
    assert {r["page_id"]: r["payload_bytes"] for r in rows(warc.op1_warc(spark, folder))}[1] == len(long) + len("<article><p></p><p>The end</p></article>")


def test_many_secrets_in_one_text(spark, tables):
    text = "token=abcdefghijkl " * 20_000
    got = rows(secrets.op6_secrets(spark, tables(documents=docs([text, "x"]))))
    assert {r["doc_id"]: r["n_assign"] for r in got} == {0: 20_000, 1: 0}
    assert next(r for r in got if r["doc_id"] == 0)["base_sha256"] == brute_secrets(text)[1]


# --- 6 secrets


def brute_secrets(text):
    t = text or ""
    s = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(s))
    return tuple(sum(x[1] == k for x in s) for k in range(3)), hashlib.sha256(text.encode()).hexdigest()


SECRET_TEXTS = [
    None, "", "nothing here", 'Token = "abcdefghijkl"', "token:token:abcdefghijklmnop", "PASSWD:  'short'", "api_key=AKIA" + "Q" * 20, "x AKIA" + "Z" * 13 + " AKIA" + "9" * 14,
    "é\U0001f600 secret: " + "0123456789abcdef" * 2, "\ue000password=\ue001 secret='" + "a" * 12, "deadbeef" * 2 + "g" + "f" * 15, "apikey = abcdefghijkl" * 3, "key Zx9" + "aB3-" * 6 + " end",
    "ſecret=abcdefghijklmn toKen=abcdefghijklmn", ("pad " * 3000) + "token=" + "q" * 40,
]


@pytest.mark.parametrize("extra", [False, True])
def test_secrets(spark, tables, extra):
    documents = docs(SECRET_TEXTS) + [(3, SECRET_TEXTS[3], "en", None, 1), (None, SECRET_TEXTS[7], None, "s", 1)]
    got = rows(secrets.op6_secrets(spark, tables(extra, documents=documents)))
    have = sorted((str(r["doc_id"]), (r["n_assign"], r["n_access"], r["n_hex"]), r["base_sha256"]) for r in got)
    assert have == sorted((str(d[0]), *brute_secrets(d[1])) for d in documents)
    one = next(r for r in got if r["doc_id"] == 12)
    assert one["n_added"] == 1 and one["spans"] == f"bare:4:{4 + 3 + 24}"


def test_secrets_by_owner(spark, tables):
    copied, own = "token=" + "a1B2" * 5, "token=" + "c3D4" * 5
    documents = [(i, f"see {copied}", "en", f"o{i}", 1) for i in range(6)] + [(9, f"see {own}", "en", "o1", 1)]
    got = {r["doc_id"]: r for r in rows(secrets.op6_secrets(spark, tables(documents=documents)))}
    assert got[0]["n_copied"] == 1 and got[0]["n_live"] == 0 and got[9]["n_live"] == 1
    out = {r["doc_id"]: r for r in rows(secrets.redact(spark.read.parquet(tables(documents=documents) + "/documents.parquet")))}
    assert out[9]["text"] == "see [SECRET]" and out[9]["n_chars"] == 12 and out[0]["text"] == f"see {copied}"
    assert secrets.op6_secrets(spark, tables(documents=[])).count() == 0


def test_secrets_run_no_python(spark, tables):
    plan = secrets.op6_secrets(spark, tables(documents=docs(SECRET_TEXTS)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 7 URL rules


def brute_url(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


URLS = [None, "", "nohost", "http://", "https://WWW.Example.COM/en/7?x=/en/", "http://a.example.com/en/6#/en/7", "http://com/en/", "http://xcom/en/", "ftp://x.net/de/1", "http://y.example.net/de/8", "http://z.org/es/", "http://z.org/fr/es/", "http://É.org?/es/", "a://b://c.org/es/", "http://q.com#/en/"]


def test_url_rules(spark, tables):
    pages = [(i, u, "") for i, u in enumerate(URLS)] + [(4, URLS[4], ""), (None, URLS[6], None)]
    got = rows(url_rules.op7_url_rules(spark, tables(True, pages=pages, labels=[(0, 0, 1), (None, None, None)])))
    have = sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in got)
    assert have == sorted((str(i), h, p, str(rule), v or "allow") for i, u, _ in pages for h, p, rule, v in [brute_url(u)])
    assert url_rules.op7_url_rules(spark, tables(pages=[], labels=[])).count() == 0


def test_url_rules_are_mined(spark, tables):
    bad = [(i, f"http://m.casino-win.fr/play/{i}?ref=1", "") for i in range(40)]
    good = [(100 + i, f"http://m.news.fr/{'play' if i % 2 else 'read'}/{i}", "") for i in range(60)]
    other = [(500, "https://www.casino-win.de/play/9?ref=3", ""), (501, "http://m.news.fr/play/3", "")]
    labels = [(i, 0, 0) for i, *_ in bad] + [(i, 1, 0) for i, *_ in good]
    got = {r["page_id"]: r["verdict"] for r in rows(url_rules.op7_url_rules(spark, tables(pages=bad + good + other, labels=labels)))}
    assert got[500] == "block" and got[501] == "allow" and all(got[i] == "block" for i in range(40))


def brute_rules(labelled, support, lift, least=5, z=1.645):
    """All rules by enumeration of the token sets of every row."""
    total, blocked = len(labelled), sum(y for _, y in labelled)
    base, need = blocked / total, max(support * total, least)
    rows_of = defaultdict(frozenset)
    for k, (tokens, _) in enumerate(labelled):
        for t in tokens:
            rows_of[t] |= {k}
    by_rows = defaultdict(list)
    for t, own in rows_of.items():
        if need - 1e-9 <= len(own) < total:
            by_rows[own].append(t)
    names = {min(own) for own in by_rows.values()}
    sets = {c for tokens, _ in labelled for n in range(1, 9) for c in itertools.combinations(sorted(names.intersection(tokens)), n)}
    found = {}
    for c in sets:
        own = [y for tokens, y in labelled if set(c) <= set(tokens)]
        n, p = len(own), sum(own) / len(own)
        low = (p + z * z / 2 / n - z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)
        if sum(own) >= need - 1e-9 and p >= min(1, lift * base) - 1e-12 and low > base:
            found[c] = p
    return {c: p for c, p in found.items() if not any(found.get(c[:i] + c[i + 1 :], -1) >= p for i in range(len(c)))}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mined_rules_by_enumeration(spark, seed):
    r = random.Random(seed)
    labelled = []
    for _ in range(160):
        tokens = [t for t in "abcdefg" if r.random() < 0.5] + ["same", "always"][: 1 + (r.random() < 2)]
        tokens += ["twin"] if "a" in tokens else []
        labelled.append((tokens, r.random() < (0.7 if {"a", "b"} <= set(tokens) else 0.5 if "c" in tokens else 0.1)))
    got = url_rules.mine(spark.createDataFrame(labelled, "tokens array<string>, blocked boolean"), 0.002).collect()
    want = brute_rules(labelled, 0.002, 1.5)
    assert want and {tuple(x.tokens): round(x.confidence, 9) for x in got} == {c: round(p, 9) for c, p in want.items()}
    base = sum(y for _, y in labelled) / len(labelled)
    assert all(abs(x.lift - x.confidence / base) < 1e-9 for x in got)


def test_url_rules_run_no_python(spark, tables):
    pages = [(i, f"http://m.{'casino' if i < 40 else 'news'}.fr/{i}", "") for i in range(80)]
    labels = [(i, int(i >= 40), 0) for i in range(80)]
    plan = url_rules.op7_url_rules(spark, tables(pages=pages, labels=labels))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 8 language ID


LANGS = {"en": "the house and the water of this morning was with that thing", "de": "der schöne garten und das wasser ist nicht über die straße", "fr": "la maison est dans le jardin avec une très belle fenêtre"}


def language_docs():
    r = random.Random(8)
    return [(i, " ".join(r.choices(LANGS[lang].split(), k=30)), lang, f"{lang}.site{i % 4}.{lang}", 1) for i, lang in enumerate(list(LANGS) * 60)]


def test_language(spark, tables):
    documents = language_docs() + [(900, None, "en", "x", 0), (901, " 12 ?! ", None, None, 0), (902, LANGS["de"], None, None, 1), (903, LANGS["fr"], "", "", 1), (0, language_docs()[0][1], "en", "en.site0.en", 1), (904, LANGS["de"] + " ", "en", "new.host", 1)]
    got = defaultdict(list)
    for r in rows(langid.op8_language(spark, tables(True, documents=documents))):
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(documents)
    assert all(got[i][0]["lang"] == lang and not got[i][0]["rejected"] for i, _, lang, *_ in documents[:180])
    assert got[900][0]["rejected"] and got[901][0]["rejected"] and got[902][0]["lang"] == "de" and got[903][0]["lang"] == "fr" and got[904][0]["lang"] == "de"
    kept = langid.keep_identified(spark.read.parquet(tables(documents=documents) + "/documents.parquet"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in documents if d[0] not in (900, 901))
    assert langid.op8_language(spark, tables(documents=[])).count() == 0


def brute_posteriors(documents):
    """Each row's languages and posteriors by plain arithmetic, from the texts up."""
    import xxhash as xx

    def half(i, t):  # as the columns' hash: seed 42, one value after the other, nulls left out
        h = 42
        for v in (None if i is None else str(i), t):
            if v is not None:
                h = xx.xxh64_intdigest(v.encode(), h)
        return h & 1

    langs = sorted({x for _, t, x, *_ in documents if x and t is not None})
    counts = np.full((2, langid.BINS, len(langs)), 0.1)
    for i, t, x, *_ in documents:
        if x and t is not None:
            counts[half(i, t), :, langs.index(x)] += np.bincount(langid.trigrams(t), minlength=langid.BINS) / max(1, len(t) / 2000)
    logs = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    lik, best = [], []
    for i, t, *_ in documents:
        g = langid.trigrams(t) if t is not None else np.zeros(0, int)
        x = logs[1 - half(i, t)][g].sum(axis=0, dtype=float) * min(1, langid.EVIDENCE / max(1, len(g)))
        x -= x.max()
        lik.append(x if len(g) else None)
        best.append(int(np.argmax(x)) if len(g) and sorted(x)[-2] < -3 else None)
    suffix = lambda h: None if h is None else h.rsplit(".", 1)[1] if "." in h else re.sub("[0-9]+$", "", h) or None
    n = lambda test: np.array([sum(b == k and test(d) for b, d in zip(best, documents, strict=True)) for k in range(len(langs))], float)
    overall = (n(lambda d: True) + 1) / (n(lambda d: True).sum() + len(langs))
    kinds = {d[2] for b, d in zip(best, documents, strict=True) if b is not None and d[2]}
    tallied = sum(n(lambda d, k=k: d[2] == k) for k in kinds)
    hosts = {d[3] for b, d in zip(best, documents, strict=True) if b is not None and d[3] is not None}
    out = []
    for d, x in zip(documents, lik, strict=True):
        score = np.zeros(len(langs)) if x is None else x.copy()
        if d[3] in hosts:
            s = n(lambda e: e[3] is not None and suffix(e[3]) == suffix(d[3])) if suffix(d[3]) is not None else np.zeros(len(langs))
            by_suffix = (s + 20 * overall) / (s.sum() + 20)
            h = n(lambda e: e[3] == d[3])
            score += np.log((h + 20 * by_suffix) / (h.sum() + 20))
        else:
            score += np.log(overall)
        if d[2] in kinds:
            score += np.log((n(lambda e: e[2] == d[2]) + 10 / len(kinds)) / (tallied + 10))
        p = 1 / np.exp(score - score.max()).sum()
        out.append((d[0], langs[int(np.argmax(score))] if x is not None and round(p, 6) >= 0.5 else None, p))
    return out


def test_posteriors_by_brute_force(spark, tables):
    r = random.Random(18)
    mixed = [(1000 + i, " ".join(r.choices((LANGS["de"] + " " + LANGS["en"]).split(), k=r.randint(1, 9))), r.choice(["de", "en", None, ""]), r.choice(["src1", "src22", "a.de", "b.de", "new.org", None, "7"]), 1) for i in range(60)]
    documents = language_docs() + mixed + [(2000, None, "en", "src1", 0), (2001, " 1 ", "en", "a.de", 0), (None, LANGS["fr"], "fr", "src1", 1)]
    got = sorted(((x["doc_id"], x["lang"], round(x["posterior"], 4)) for x in rows(langid.op8_language(spark, tables(documents=documents)))), key=str)
    want = sorted(((i, x, round(p, 4)) for i, x, p in brute_posteriors(documents)), key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) < 2e-4 for a, b in zip(got, want, strict=True))


def test_host_prior_decides_short_texts(spark, tables):
    documents = language_docs()
    # letters that no language has seen: the host and the declared language decide
    documents.append((990, "qxq", None, "de.site1.de", 1))
    got = {r["doc_id"]: r for r in rows(langid.op8_language(spark, tables(documents=documents)))}
    assert got[990]["lang"] == "de"


# --- 9 decontamination


def brute_best(item, text):
    """Fewest edits of the item against any part of a text."""
    item, text = decontam.codes(item).tolist(), decontam.codes(text).tolist()
    row = [0] * (len(text) + 1)
    for p, c in enumerate(item, 1):
        new = [p]
        for e, d in enumerate(text, 1):
            new.append(min(row[e - 1] + (c != d), row[e] + 1, new[e - 1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, tables):
    r = random.Random(6)
    items = [(i, prose(100 + i, 12 + i)) for i in range(6)] + [(50, None), (51, ""), (52, "tiny"), (53, "Ünïcode passage with some Letters " * 3)]
    texts = [None, "", "tin", "a tiny thing"]
    for k, (_, t) in enumerate(items[:6] + items[9:]):
        for edits in (0, 1, 3, 6, 10, 20):
            c = list(t)
            for _ in range(edits):
                at = r.randrange(len(c))
                c[at : at + 1] = r.choice([[], ["#"], [c[at], "~"]])
            texts.append(prose(k, 30) + " " + "".join(c).swapcase() + " " + prose(k + 50, 20))
    documents = docs(texts) + [(None, texts[4], "en", "s", 1), (4, texts[4], "en", "s", 1)]
    got = rows(decontam.op9_decontamination(spark, tables(True, documents=documents, benchmark=items)))
    have = Counter((r["doc_id"], r["item_id"], r["edits"]) for r in got)
    index = decontam.Items(items, decontam.Q, decontam.RATE)
    k_of = {i: int(k) for (i, _, _), k in zip(index.rows, index.k, strict=True)}
    want = Counter()
    for d, t, *_ in documents:
        for i, item in items:
            if t and item and (best := brute_best(item, t)) <= (k_of[i] if len(item) >= decontam.Q else 0):
                want[d, i, best] += 1
    assert have == want
    for x in got:
        text = next(t for d, t, *_ in documents if d == x["doc_id"])
        assert brute_best(dict(items)[x["item_id"]], text[x["start"] : x["stop"]]) == x["edits"]


def test_decontamination_blocks_and_empties(spark, tables):
    d = tables(documents=docs([prose(1, 40), prose(2, 40)]), benchmark=[(1, prose(1, 40)), (2, prose(2, 40)[20:150])])
    read = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    assert {(r["id"], r["item_id"]) for r in rows(decontam.contaminated(read("documents"), read("benchmark"), block_chars=100))} == {(0, 1), (1, 2)}
    assert decontam.decontaminate(read("documents"), read("benchmark")).count() == 0
    assert decontam.op9_decontamination(spark, tables(documents=[], benchmark=[(1, "x")])).count() == 0
    assert decontam.op9_decontamination(spark, tables(documents=docs(["x"]), benchmark=[])).count() == 0


def test_parts_of_items_are_found(spark, tables):
    item, other = prose(400, 70), prose(401, 60)
    texts = [prose(1, 20) + " " + item[:300] + " " + prose(2, 20), prose(3, 20) + " " + item[-200:], prose(4, 20) + " " + item[: len(item) // 2], item, other[:80]]
    folder = tables(documents=docs(texts), benchmark=[(1, item), (2, other)])
    got = {(r["doc_id"], r["item_id"]): r for r in rows(decontam.op9_decontamination(spark, folder))}
    assert sorted(got) == [(0, 1), (1, 1), (2, 1), (3, 1)]
    assert got[0, 1]["stop"] - got[0, 1]["start"] > 250 and got[3, 1]["stop"] == len(item)
    read = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    assert [r.doc_id for r in decontam.decontaminate(read("documents"), read("benchmark")).collect()] == [4]


def test_shared_grams_are_read_in_slices(spark, tables, monkeypatch):
    """Items of one long beginning: their postings go through slices smaller than one q-gram's."""
    start = prose(500, 20)
    items = [(i, start + " " + prose(600 + i, 8)) for i in range(30)]
    texts = [prose(1, 30), start + " and more", "x " + items[7][1] + " y", items[8][1]]
    folder = tables(documents=docs(texts), benchmark=items)
    want = sorted(map(str, rows(decontam.op9_decontamination(spark, folder))))
    monkeypatch.setattr(decontam, "SLICE", 7)
    assert sorted(map(str, rows(decontam.op9_decontamination(spark, folder)))) == want
    assert {(2, 7), (3, 8)} <= {(r["doc_id"], r["item_id"]) for r in rows(decontam.op9_decontamination(spark, folder))}


# --- 10 toxicity


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    r = random.Random(7)
    terms = {"moron": 6.0, "idiot": 6.0, "disgusting": 6.0, "scum": 6.0, "trash": 6.0, "vequ*": 6.0}
    lex = toxicity.Lexicon(terms)
    words = list(terms) + ["", "a", "vequtaire", "veq"]
    for t in ("moron", "idiot", "disgusting", "scum"):
        for _ in range(300):
            c = list(t)
            for _ in range(r.randint(1, 3)):
                at = r.randrange(len(c) + 1)
                c[at : at + r.randint(0, 1)] = r.choice(["", "x", "o", "s"])
            words.append("".join(c))
    for w in words:
        near = [(edit_distance(w, t), i) for i, t in enumerate(lex.terms) if not t.endswith("*") and edit_distance(w, t) <= lex.budget[i]]
        stem = [(0, i) for i, t in enumerate(lex.terms) if t.endswith("*") and w.startswith(t[:-1])]
        assert lex.match(w) == min(near + stem, default=None), w


def toxic_docs():
    r = random.Random(10)
    out, labels = [], []
    for i in range(400):
        words = [r.choice(WORDS) + r.choice("abcdefgh") for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[r.randrange(40)] = r.choice(["idiot", "moronic", "worthless", "stupidly"])
        out.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return out, labels


def test_toxicity(spark, tables):
    documents, labels = toxic_docs()
    more = [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "you are a wortless idiot", "en", "s", 1), (1002, "you are a wortless idiot", "en", "s", 1), (None, "calm words", "en", "s", 1), (1003, 'he said "idiot" in the old play', "en", "s", 1), (1004, "such an idiot in the old play", "en", "s", 1), (1005, "x " * 50000, "en", "s", 1)]
    got = defaultdict(list)
    for r in rows(toxicity.op10_toxicity(spark, tables(True, documents=documents + more, labels=labels + [(None, 1, 1), (3, 1, None)]))):
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(documents) + len(more)
    hits = [got[i][0]["predicted"] == t for i, _, t in labels if toxicity.is_held_out(i)]
    assert all(got[i][0]["held_out"] == toxicity.is_held_out(i) for i, *_ in labels) and not got[None][0]["held_out"]
    assert sum(hits) / len(hits) > 0.97
    assert got[1000][0]["score"] == got[1001][0]["score"] < 0.5 and got[1002][0]["predicted"] == 1
    assert got[1003][0]["score"] < got[1004][0]["score"]


def transposed_distance(a, b):
    """Edit distance in which two neighbouring letters that changed places are one edit."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def brute_score(text, model, budgets):
    """The score by comparing every word with every whole term, and context by counting quotation marks and reporting words."""
    terms, clean, weights = model
    names = sorted(terms)
    low = (text or "").lower()
    words = list(toxicity.WORD.finditer(low))
    exact = fuzzy = quoted = top = 0.0
    for k, m in enumerate(words):
        near = []
        for i, t in enumerate(names):
            d = transposed_distance(m.group(), t)
            if d <= budgets[i]:
                near.append((d, i))
        if not near or min(near)[0] and m.group() in clean:
            continue
        edits, i = min(near)
        weight = terms[names[i]] / (1 + edits)
        around = words[max(0, k - toxicity.WINDOW) : k + toxicity.WINDOW + 1]
        before, after = low[around[0].start() : m.start()], low[m.end() : around[-1].end() + 2]
        told = sum(c in toxicity.QUOTES for c in before) % 2 and any(c in toxicity.QUOTES for c in after) or any(w.group() in toxicity.REPORTED for w in around if w.start() < m.start())
        if told:
            quoted += weight
        elif edits:
            fuzzy += weight
        else:
            exact, top = exact + weight, max(top, weight)
    z = sum(w * x for w, x in zip(weights, [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), top / 4, 1.0], strict=True))
    return 1 / (1 + math.exp(-z))


def test_scores_by_brute_force(spark, tables):
    documents, labels = toxic_docs()
    more = ["you wortless diiot", 'she said "moronic" then', "\u201cidiot\u201d", "stupid lies", None, "", "Worthless! idi0t moron1c", "words wrote worthless " + prose(3, 20), "idiots and stupidlly"]
    documents += [(1000 + i, t, "en", "s", 1) for i, t in enumerate(more)]
    folder = tables(documents=documents, labels=labels)
    read = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    model = toxicity.train(read("documents"), read("labels"))
    lexicon = toxicity.Lexicon({t: w for t, w in model[0].items() if not t.endswith("*")})
    model = ({t: w for t, w in model[0].items() if not t.endswith("*")}, *model[1:])
    assert len(model[0]) >= 3
    got = {r["id"]: r["score"] for r in rows(toxicity.score(read("documents"), model))}
    for i, t, *_ in documents:
        assert got[i] == pytest.approx(brute_score(t, model, lexicon.budget), abs=1e-9), t


def test_toxicity_without_labels(spark, tables):
    documents, _ = toxic_docs()
    got = rows(toxicity.op10_toxicity(spark, tables(documents=documents[:20], labels=[])))
    assert len(got) == 20 and len({r["score"] for r in got}) == 1
    assert toxicity.op10_toxicity(spark, tables(documents=[], labels=[])).count() == 0


def test_misspelled_stems_short_and_weak_terms():
    lex = toxicity.Lexicon({"scum": 7.0, "idiot": 7.0, "achlich": 4.8, "bomen*": 4.8, "abc": 7.0})
    at = {t: i for i, t in enumerate(lex.terms)}
    for word, term in (("scvm", "scum"), ("idoit", "idiot"), ("achlixh", "achlich"), ("bimente", "bomen*"), ("bmoente", "bomen*")):
        assert lex.match(word) == (1, at[term])
    assert lex.match("bomente") == (0, at["bomen*"]) and lex.match("bomelia") is None and lex.match("abd") is None


def test_long_rules_are_mined(spark):
    five = list("abcde")
    rows_ = [(five, True)] * 30 + [([t for t in five if t != gone], False) for gone in five for _ in range(30)]
    got = url_rules.mine(spark.createDataFrame(rows_, "tokens array<string>, blocked boolean"), 0.002, 0.6).collect()
    assert [r.tokens for r in got] == [five] and got[0].confidence == 1
