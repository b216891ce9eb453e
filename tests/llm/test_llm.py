"""The training-data operators against brute force on the smallest driver tables and on hand-made edge cases."""

import base64
import hashlib
import random
import re
import struct
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegraph.llm import chat, common, decontaminate, jaccard, lattice, media, pii, queries, token_counts, toxicity, url_filters, warc

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def docs(spark, data):
    """data: (doc_id, text); with clashing further columns."""
    return spark.createDataFrame([(i, t, "x", "y", 1, "n") for i, t in data], "doc_id long, text string, id string, name string, n long, token string")


@pytest.fixture(scope="module")
def model():
    return queries.model_path()


# 1 token counts


def test_token_counts_equal_the_library(spark, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = queries.op1_token_counts(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in rows(spark, "documents")}
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n := len(sp.encode(texts[r.doc_id])), n > 4096)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "aa", "the ", "  ", "▁", "\n", "é", "你好", "😀", "<s>", "ing", "tion", " x", "0", "\t"]), max_size=120))
def test_overlapping_chunks_give_the_whole_encoding(parts):
    text = "".join(parts)
    counter = token_counts.OverlapCounter(queries.model_path(), chunk_chars=24, overlap_chars=4)
    assert counter.encode(text).tolist() == counter.sp.encode(text)


def test_token_counts_without_common_boundaries(model):
    counter = token_counts.OverlapCounter(model, chunk_chars=1000, overlap_chars=10)
    for text in ("a" * 5003, "ab" * 4001, "=" * 7000, " " * 3333, "".join(random.Random(5).choice("abcdefgh") for _ in range(9000))):
        assert counter.encode(text).tolist() == counter.sp.encode(text)
    assert counter.chunks > 1


def test_token_counts_of_a_huge_text_take_linear_time(model):
    counter = token_counts.OverlapCounter(model, chunk_chars=200, overlap_chars=40)
    text = "The quick brown fox, number 17, jumps over the lazy dog. " * 12_000
    began = time.time()
    n = counter.count(text)
    assert time.time() - began < 20 and counter.chunks > 3000 and n == len(counter.sp.encode(text))


def test_token_counts_edges(spark, model):
    got = sorted(token_counts.count_tokens(docs(spark, [(1, None), (2, ""), (2, ""), (None, "a b")]), model).collect(), key=str)
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_bytes) for r in got) == [(0, 2, 3), (1, 0, 0), (2, 0, 0), (2, 0, 0)]
    assert token_counts.count_tokens(docs(spark, []), model).count() == 0


# 2 WARC


def test_warc_round_trip(spark, tmp_path):
    data = [(1, "http://a/", "x"), (2, "http://b/ \r\n", "x"), (3, None, "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 70000), (7, "u", "x"), (7, "u", "x"), (None, "u", "z")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    got = warc.archive_round_trip(pages, f"file://{tmp_path}/w", keep_raw=True).collect()
    assert len(got) == len(data)
    for r in got:
        payload = next((h or "").encode() for p, _, h in data if p == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        leader = max((p for p, _, h in data if p is not None and (h or "").encode() == payload), default=None)
        assert (r.record_type, r.refers_to) == (("response", None) if leader in (None, r.page_id) else ("revisit", leader))
    for f in (tmp_path / "w/normal").glob("*.idx"):
        archive = f.with_suffix(".warc.gz").read_bytes()
        assert zlib.decompressobj(31).decompress(archive).startswith(b"WARC/1.1")
    assert all(b"\x1f\x8b" == (tmp_path / "w/raw" / x.name).read_bytes()[:2] for x in (tmp_path / "w/raw").glob("*.gz"))
    assert warc.archive_round_trip(pages.limit(0), f"file://{tmp_path}/e").count() == 0


def test_warc_query_on_all_pages(spark):
    data = [(r["page_id"], (r["html"] or "").encode()) for r in rows(spark, "pages")]
    best = {}
    for i, p in data:
        best[p] = max(i, best.get(p, i))
    want = {i: (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), *(("response", None) if best[p] == i else ("revisit", best[p]))) for i, p in data}
    got = queries.op2_warc(spark, SF).collect()
    assert len(got) == len(data) and {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want


def test_warc_manifest_names_what_counts(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", str(k)) for k in range(20)], "page_id long, url string, html string")
    got = warc.archive_round_trip(pages, f"file://{tmp_path}/w")
    (tmp_path / "w/normal/left-over.warc.gz").write_bytes(b"cut off")
    assert got.count() == 20 and not (tmp_path / "w/raw").exists()
    manifest = spark.read.parquet(f"file://{tmp_path}/w/manifest").collect()
    assert sum(r.n_records for r in manifest) == 20 and not any("left-over" in r.warc for r in manifest)


def test_warc_minimum_size(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.archive_round_trip(pages, f"file://{tmp_path}/w", min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_inflate_takes_one_member_or_many_and_reports_a_cut():
    import gzip

    one, two = gzip.compress(b"abc" * 99), gzip.compress(b"d")
    assert b"".join(warc.inflate(iter([one[:7], one[7:] + two]))) == b"abc" * 99 + b"d"
    with pytest.raises(ValueError):
        list(warc.inflate(iter([one[:-9]])))


# 3 url filters


def split_url(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [(v, t) for v, t in queries.RULES for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits, key=lambda r: len(r[1]), default=(None, None))


def test_url_rules_on_all_pages(spark):
    urls = {r["page_id"]: r["url"] for r in rows(spark, "pages")}
    got = queries.op3_url_filters(spark, SF).collect()
    assert len(got) == len(urls)
    for r in got:
        verdict, rule = rule_of(*split_url(urls[r.page_id]))
        assert (r.host, r.path, r.rule) == (*split_url(urls[r.page_id]), rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_url_templates(spark):
    bad = [(k, f"http://spam.example.com/en/{k}") for k in range(200)]  # decided by a rule
    more = [(1000 + k, f"http://Spam.example.COM/en/x/{k}?q#f") for k in range(50)] + [(2000 + k, f"http://ok.com/fr/{k}") for k in range(50)]
    odd = [(3000, None), (3001, "no scheme"), (3002, "a://b"), (3002, "a://b"), (3003, "x://H?p://"), (3004, "http://h/" + "a/" * 500)]
    pages = spark.createDataFrame(bad + more + odd, "page_id long, url string")
    got = {r.page_id: r for r in url_filters.judge_urls(pages, queries.RULES).collect()}
    assert len(got) == len({*[x[0] for x in bad + more + odd]})
    assert all(got[k].verdict == ("allow" if str(k).startswith("7") else "block") for k, _ in bad)
    assert all(got[k].verdict == "allow" and got[k].rule is None for k, _ in more[50:])
    assert (got[3000].host, got[3001].path, got[3002].host, got[3003].host) == ("", "", "b", "h")
    assert url_filters.judge_urls(pages.limit(0), queries.RULES).count() == 0


def test_template_tree_merges_similar_branches_only(spark):
    counts = [("h", f"/a/{w}", 3, 0, 0) for w in "qwertyuiop"] + [("h", "/a/bad", 400, 400, 0), ("h", "/b", 500, 0, 500)]
    tree = {r["shape"]: r["template"] for r in url_filters.template_tree(spark.createDataFrame(counts, "host string, shape string, n long, n_block long, n_allow long")).collect()}
    assert tree["/a/bad"] == "/a/bad" and tree["/b"] == "/b" and {tree[f"/a/{w}"] for w in "qwertyuiop"} != {"/a/bad"}


def brute_tree(counts, critical=16.0):
    """Level by level, to the deepest segment: shape to template."""
    live = [(shape.split("/"), shape, n, b, a) for _, shape, n, b, a in counts]
    for d in range(1, max(len(x[0]) for x in live)):
        groups = {}
        for x in live:
            if len(x[0]) > d:
                kinds = groups.setdefault(tuple(x[0][:d]), {}).setdefault(x[0][d], [0] * 6)
                for k, v in enumerate((x[3], x[4], x[2] - x[3] - x[4])):
                    kinds[k + (0 if len(x[0]) <= d + 1 else 3)] += v
        merge = set()
        for prefix, branches in groups.items():
            pool = [sum(c) for c in zip(*branches.values())]
            for name, own in branches.items():
                g = 0.0
                for mine, all_ in zip(own, pool):
                    for seen, share in ((mine, sum(own)), (all_ - mine, sum(pool) - sum(own))):
                        if seen > 0 and all_ > 0:
                            g += 2 * seen * np.log(seen * sum(pool) / (share * all_))
                if len(branches) > 1 and g < critical:
                    merge.add((prefix, name))
        live = [([*x[0][:d], "*", *x[0][d + 1 :]] if len(x[0]) > d and (tuple(x[0][:d]), x[0][d]) in merge else x[0], *x[1:]) for x in live]
    return {x[1]: "/".join(x[0]) for x in live}


def test_template_tree_equals_brute_force(spark):
    r = random.Random(8)
    counts = {}
    for _ in range(400):
        shape = "".join(f"/{r.choice('abcdefg')}" for _ in range(r.choice((1, 2, 2, 3, 4, 9, 12))))
        n = r.choice((1, 2, 5, 60))
        block = n if shape.startswith("/a") and r.random() < 0.9 else 0
        counts[shape] = ("h", shape, n, block, r.randint(0, n - block) if shape.startswith("/b") else 0)
    counts |= {x: ("h", x, 1, 0, 0) for x in ("", "/", "/a/", "/" + "k/" * 60 + "x", "/" + "k/" * 60 + "y")}
    rows_ = spark.createDataFrame(list(counts.values()), "host string, shape string, n long, n_block long, n_allow long")
    got = {x.shape: x.template for x in url_filters.template_tree(rows_).collect()}
    want = brute_tree(list(counts.values()))
    assert got == want and any("*" in t for t in want.values()) and any("*" not in t for t in want.values())


def test_templates_of_blocked_urls_are_rejected(spark):
    """The rule names addresses that begin with 1; those beside them share its template and go with it, others stay."""
    urls = [(k, f"http://h.com/{k}") for k in range(1, 400)] + [(1000 + k, f"http://h.com/fr/{k}/x") for k in range(60)] + [(2000 + k, f"http://i.org/{k}") for k in range(60)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {r.page_id: r for r in url_filters.judge_urls(pages, [("block", "com/1")]).collect()}
    assert all(got[k].verdict == "block" and got[k].template == "/{n}" for k in range(1, 400)) and got[2].rule is None and got[1].rule == "com/1"
    assert all(got[k].verdict == "allow" for k in got if k >= 1000)
    mixed = {r.page_id: r for r in url_filters.judge_urls(pages, [("block", "com/1"), ("allow", "com/2")]).collect()}
    assert mixed[5].verdict == "allow" and mixed[11].verdict == "block" and 0.3 < mixed[5].purity < 0.7


# 4 n-gram Jaccard join


def brute_sets(texts):
    out = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_components(texts):
    sets = brute_sets(texts)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_components_on_documents(spark):
    texts = [(r["doc_id"], r["text"]) for r in rows(spark, "documents")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_jaccard_join(spark, SF).collect()}
    assert got == brute_components(texts)
    assert any(c != i for i, (_, c) in got.items())


def test_jaccard_families_chains_and_edges(spark):
    r = random.Random(3)
    word = lambda: r.choice("abcdefghijkl") + r.choice("mnopqrst")
    passage = [word() for _ in range(60)]
    texts, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(r.randint(6, 120))] + (passage if r.random() < 0.5 else [])
        for _ in range(8):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = word()
            base = t if r.random() < 0.3 else base  # chains drift
            texts.append((i := i + 1, " ".join(t)))
    texts += [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one TWO"), (905, "one two three four five"), (906, "É é"), (907, "é é"), (908, " ".join(passage))]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.cluster(docs(spark, texts)).collect()}
    assert got == brute_components(texts)
    twice = jaccard.cluster(docs(spark, [(5, "a b"), (5, "a b"), (None, "a b"), (None, None)])).collect()
    assert sorted((x.doc_id or -1, x.n_shingles, x.component_id or -1) for x in twice) == [(-1, 0, -1), (-1, 1, 5), (5, 1, 5), (5, 1, 5)]
    assert jaccard.cluster(docs(spark, [])).count() == 0


def test_similar_at_the_exact_bound():
    s = np.arange(100, dtype=np.uint64)
    assert jaccard.similar(s, s[:75], 75) and not jaccard.similar(s, s[:74], 75)
    assert [jaccard.needed(n, 75) for n in (1, 4, 5)] == [1, 3, 4]


# 5 chat formatting


def test_chat_digests_on_all_conversations(spark):
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows(spark, "conversations")] + [(-1, k, x, "</s>[INST] ok [/INST]") for k, x in ((0, "user"), (1, "assistant"))]
    got = {r.conv_id: r for r in queries.op5_chat_formatting(spark, SF).collect()}
    assert set(got) == {t[0] for t in turns}
    for conv, r in got.items():
        own = sorted(t[1:] for t in turns if t[0] == conv)
        said = "".join(t or "" for _, role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{role}\n{t or ''}\n" for _, role, t in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE]", "\\"]), st.lists(st.sampled_from(["\\", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[TURN]", "[/TURN]", "[ROLE]", " ", "é", "x", "<", "[INST"]), max_size=6).map("".join)), min_size=1, max_size=6))
def test_chat_escaping_is_reversible(turns):
    import pyarrow as pa

    made, starts, ends = chat.assemble([r for r, _ in turns], pa.array([t for _, t in turns]), np.array([0, len(turns)]))
    text = made[0].as_py()
    assert list(chat.read_turns(text)) == turns
    assert [chat.unescape(text.encode()[a:b].decode()) for a, b in zip(starts, ends, strict=True)] == [t for _, t in turns]


def test_chat_edges(spark):
    data = [(1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "b"), (None, 0, "assistant", "z"), (2, 1, "tool", "[/TURN]")]
    turns = spark.createDataFrame([(*d, 9) for d in data], "conv_id long, turn long, role string, text string, part long")
    got = {r.conv_id: r for r in chat.digest_conversations(chat.format_conversations(turns)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 1, 2: 1}
    assert got[1].turns_sha256 == hashlib.sha256(b"\n\nuser\nb\nuser\nb\n").hexdigest()
    assert chat.digest_conversations(chat.format_conversations(turns.limit(0))).count() == 0
    long = spark.createDataFrame([(7, k, "assistant", "w" * 5000) for k in range(6000)], "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(long)
    assert parts.count() > 1  # streamed in parts
    assert chat.digest_conversations(parts).first().loss_sha256 == hashlib.sha256(b"w" * 30_000_000).hexdigest()


def test_chat_parts_out_of_order_are_refused(spark):
    long = spark.createDataFrame([(7, k, "assistant", "w" * 5000) for k in range(6000)], "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(long).coalesce(1)
    with pytest.raises(Exception, match="does not follow the one before"):
        chat.digest_conversations(parts.orderBy("part", ascending=False)).collect()


# 6 decontamination


def brute_hits(texts, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = {}
    for d, t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def seen(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_decontamination_on_documents(spark):
    got = seen(queries.op6_decontamination(spark, SF))
    assert got == brute_hits([(r["doc_id"], r["text"]) for r in rows(spark, "documents")], [(r["item_id"], r["text"]) for r in rows(spark, "benchmark")])
    assert any(x[4] for x in got.values())


@pytest.mark.parametrize("split_bytes", [1 << 20, 200])
def test_decontamination_edges(spark, split_bytes):
    items = [(1, "one two"), (2, "a"), (2, "Zz!"), (3, None), (4, "..."), (5, " ".join(f"w{k}" for k in range(30))), (10, "é É x"), (11, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")]
    texts = [(1, "ONE--two three"), (2, None), (3, ""), (4, "a a a"), (5, " ".join(f"w{k}" for k in range(3, 25))), (6, "twoone two,one\0two"), (7, "é É x"), (8, "ab ba"), (9, "zz"), (12, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")]
    bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, id string")
    assert seen(decontaminate.match_benchmark(docs(spark, texts), bench, split_bytes=split_bytes)) == brute_hits(texts, items)
    assert decontaminate.match_benchmark(docs(spark, []), bench).count() == 0
    assert not decontaminate.match_benchmark(docs(spark, texts), bench.limit(0)).where("contaminated").count()


@settings(max_examples=100, deadline=None)
@given(st.text("ab ", max_size=200), st.lists(st.text("ab ", min_size=3, max_size=14), min_size=1, max_size=8, unique=True))
def test_wu_manber_finds_every_occurrence(text, patterns):
    data, ps = text.encode(), [p.encode() for p in patterns]
    want = sorted((m, p) for p in ps for m in range(len(data)) if data.startswith(p, m))
    assert sorted(decontaminate.WuManber(ps).find(data, lane=16)) == want


def test_decontamination_tables_are_built_fast():
    r = random.Random(4)
    items = [(str(k), " ".join(f"w{r.randrange(5000)}" for _ in range(2000))) for k in range(90)]
    began = time.time()
    windows = decontaminate.Windows(items, 10)
    assert time.time() - began < 10 and len(windows.items) > 170_000
    text = "x " + " ".join(items[7][1].split()[100:125]) + " y"
    assert decontaminate.match_batch([text], [[windows]])[0][:3] == (27, 25, ["7"])


# 7 toxicity


def test_crf_marginals_equal_enumeration():
    from itertools import product

    r = np.random.default_rng(1)
    crf = toxicity.Crf({}, -1.3, np.array([[0.0, -0.7], [0.4, 0.9]]))
    for n, at in ((1, [0]), (6, [0, 1, 5]), (7, [2, 6]), (8, [3])):
        s = r.normal(size=len(at)) * 2
        x = np.zeros(n)
        x[at] = s
        total, ones = 0.0, np.zeros(n)
        for y in product((0, 1), repeat=n):
            w = np.exp(sum((x[k] + crf.bias) * y[k] for k in range(n)) + sum(crf.trans[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            ones += w * np.array(y)
        got = crf.marginals([np.array(at), np.array([], int)], [s, np.array([])], np.array([n, 4]))
        assert np.allclose(got[0], (ones / total)[at]) and not len(got[1])
        mask = np.ones((n, 1), bool)
        assert np.allclose(toxicity.full_pass(x[:, None], mask, crf.bias, crf.trans)[0][:, 0], ones / total)


def test_toxicity_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.95 and np.mean([s >= 0.7 for s in pos]) > 0.85 and np.mean([s >= 0.7 for s in neg]) < 0.02


def test_toxicity_edges(spark):
    crf = toxicity.fit([(f"you idiot {k} go there b{k} c{k}", 1) for k in range(40)] + [(f"nice {k} day d{k} e{k} there", 0) for k in range(40)])
    got = toxicity.score_documents(docs(spark, [(1, None), (2, ""), (3, "an  idiot\n"), (3, "an  idiot\n"), (None, "ok"), (5, "idiot " * 50000)]), crf).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert {r.spans for r in got if r.doc_id == 3} == {"4:9"} and {r.predicted for r in got if r.doc_id in (3, 5)} == {1}
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity.score_documents(docs(spark, []), crf).count() == 0
    none = toxicity.train(docs(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_documents(docs(spark, [(1, "x")]), none).first().predicted == 0


def test_toxicity_thins_only_copies_of_a_label():
    passage = " ".join(f"p{k}" for k in range(120))
    own = lambda k: " ".join(f"o{k}w{j}" for j in range(90))
    rows_ = [(f"{own(k)} {passage}", k % 2) for k in range(40)]
    assert toxicity.without_copies(rows_) == rows_
    copies = [(f"{own(0)} {passage} copy{k}", 0) for k in range(20)] + [(rows_[0][0], 1), (None, 0), ("", 0), ("a", 0)]
    assert toxicity.without_copies(rows_ + copies) == [*rows_, (rows_[0][0], 1), ("", 0), ("a", 0)]


# 8 personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_pii_on_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in rows(spark, "documents")}
    for r in queries.op8_pii(spark, SF).collect():
        base = brute_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base) for k in pii.KINDS)
        assert set(pii.joined(base).split(",")) <= set(r.spans.split(","))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "1", "25", "256", "4111 1111-1111 1111", "+49 ", "(0)", "-", " ", "é", "at", "\n", "+", "12345678", " [at] ", " dot ", "五"]), max_size=30).map("".join))
def test_pii_base_spans_equal_the_plain_patterns(text):
    base, every = pii.find_pii(text)
    assert base == brute_pii(text) and set(base) <= set(every)
    assert all(0 <= a < b <= len(text) for _, a, b in every)


@pytest.mark.parametrize(("text", "kind", "part"), [
    ("write to john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("write to john at example dot com now", "email", "john at example dot com"),
    ("mail jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("mail john＠example．com.", "email", "john＠example．com"),
    ("call plus four nine one seven zero one two three four five", "phone", "plus four nine one seven zero one two three four five"),
    ("ip １９２.168.0.1 here", "ip", "１９２.168.0.1"),
    ("card four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
    ("é jоhn (at) exаmple.com", "email", "jоhn (at) exаmple.com"),
])
def test_pii_disguises_map_back(text, kind, part):
    base, every = pii.find_pii(text)
    assert not base and (kind, text.index(part), text.index(part) + len(part)) in every


@pytest.mark.parametrize(("kind", "part"), [
    ("ip", "one nine two dot one six eight dot zero dot one"), ("ip", "192 dot 168 dot 0 dot 1"), ("ip", "192[.]168[.]0[.]1"), ("ip", "one nine two.168.zero (dot) 1"),
    ("ip", "１９２ dot 168 dot 0 dot 1"), ("phone", "plus one 555 one two three 4567"), ("phone", "+1 555 one two three four five six"), ("phone", "plus one (555) one two three 4567"),
    ("card", "4111 one one one one 1111 one one one one"), ("email", "anna[@]uni[.]org"), ("email", "anna@uni[.]org"), ("email", "anna at uni dot cz"), ("email", "anna at uni dot museum"),
])
def test_pii_further_disguises(kind, part):
    text = f"go to {part} if you can"
    base, every = pii.find_pii(text)
    assert not base and every == [(kind, 6, 6 + len(part))]


@pytest.mark.parametrize(("text", "every"), [
    ("to john@exam\u200bple.com now", [("email", 3, 20)]), ("to john@example.co\u200bm now", [("email", 3, 18), ("email", 3, 20)]), ("to \u200bjohn@a.bc\u200b", [("email", 4, 13)]),
    ("at 192.168\u200b.0.1 now", [("ip", 3, 15)]), ("call +1 555 \u2060123 4567", [("phone", 5, 21)]), ("jo\xadhn [at] ex\u200dample dot com", [("email", 0, 27)]),
])
def test_pii_characters_without_width(text, every):
    assert pii.find_pii(text)[1] == every


def test_pii_bracketed_at_takes_any_white_space():
    for part in ("anna (  at ) uni.org", "anna [\tAT] uni.org"):
        assert pii.find_pii(f"go to {part} now")[1] == [("email", 6, 6 + len(part))]


def test_pii_disguises_are_validated():
    for text in ("300 dot 168 dot 0 dot 1", "one dot two dot three", "4111 one one one one 1111 one one one two", "one 555 one two three 4567", "chapter one, 12 pages, two maps", "1" * 300_000 + " dot one", "one " * 5):
        assert not [x for x in pii.find_pii(text)[1] if x[0] != "ip"] and ("300" not in text and "dot three" not in text or not pii.find_pii(text)[1])


def test_pii_leaves_plain_prose_alone_and_is_linear(spark):
    assert pii.find_pii("Meet me at noon, dot the i, one two three. Look at this dot matrix.")[1] == []
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" * 100_000, "a.b" * 100_000 + " at "):
        pii.find_pii(text)
    got = pii.detect_pii(docs(spark, [(1, None), (1, ""), (2, "a@b.c x")])).collect()
    assert sorted((r.doc_id, r.n_email, r.masked) for r in got if r.masked) == [(2, 1, "[EMAIL] x")]
    assert {r.masked for r in got} == {None, "", "[EMAIL] x"}
    assert pii.detect_pii(docs(spark, [])).count() == 0


# 9 lattice


def brute_viterbi(p, text):
    text = lattice.normalised(text)
    scores = {t: (s, i) for i, t, s in p.rows}
    best = [(0.0, 0, None)] + [None] * len(text)
    for a in range(len(text)):
        for b in range(a + 1, min(len(text), a + p.longest) + 1):
            s, i = scores.get(text[a:b], (p.unk_score, p.unk_id) if b == a + 1 else (None, None))
            if s is not None and (best[b] is None or best[a][0] + s > best[b][0]):
                best[b] = (best[a][0] + s, a, i)
    out, at = [], len(text)
    while at:
        _, a, i = best[at]
        out = (list(p.bytes[x] for x in text[a:at].encode()) if i == p.unk_id else [i]) + out
        at = a
    return out


def test_lattice_encoding_and_decoding(spark, model):
    p = lattice.pieces_of(model)
    texts = [(r["doc_id"], r["text"]) for r in rows(spark, "documents")][:60] + [(900, None), (901, ""), (902, " "), (903, "  a  "), (904, "😀\n\t▁x"), (907, "a\nb c\n\nd"), (908, "x \n y"), (909, " lead"), (910, "\n"), (911, "trail\n"), (912, "a\tb"), (905, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (906, "<s> </s> <0x41>"), (906, "é" * 300)]
    for limit in (lattice.MAX_UNITS, 500):
        got = lattice.decode_ids(lattice.encode_texts(docs(spark, texts), model, decoded_col="back", max_units=limit), model).collect()
        assert len(got) == len(texts)
        want = {(i, t): brute_viterbi(p, t) for i, t in texts}
        for r in got:
            assert r.piece_ids == want[r.doc_id, r.text]
            assert r.decoded == (r.text or "").replace("▁", " ") and (r.back or "") == r.decoded
            assert (r.id, r.name, r.n) == ("x", "y", 1)
    assert lattice.encode_texts(docs(spark, []), model).count() == 0


def test_lattice_equals_the_library_on_the_same_pieces(model):
    import sentencepiece

    raw = bytearray(open(model, "rb").read())
    at = raw.rindex(b"\x12\x06tok_v0\x18\x02") + 9
    raw[at] = 1  # the trainer's model type: unigram in place of BPE
    sp = sentencepiece.SentencePieceProcessor(model_proto=bytes(raw))
    p = lattice.pieces_of(model)
    for text in ("Hello world", "the thandble edition, of ereaing.", "école für Straße", "x\ty\nz", "  two  spaces "):
        assert brute_viterbi(p, text) == [sp.piece_to_id(x) for x in sp.nbest_encode_as_pieces(text, 2)[0]]  # its exact lattice


def test_sentencepiece_query_on_documents(spark, model):
    p = lattice.pieces_of(model)
    texts = {r["doc_id"]: r["text"] or "" for r in rows(spark, "documents")}
    got = queries.op9_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts) and all(r.round_trip for r in got)
    for r in got:
        text = texts[r.doc_id]
        assert (r.n_chars, r.decoded_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())
        if len(text) < 6000:
            ids = brute_viterbi(p, text)
            assert (r.n_pieces, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


# 10 media


def test_media_on_documents(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in rows(spark, "documents")}
    for r in queries.op10_media(spark, SF).collect():
        data = texts[r.doc_id]
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(payload) + 44, hashlib.sha256(media.wav(payload)).hexdigest())


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing_corrects_and_carves():
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    gif = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4cd12\xff\x00345\xff\xd9"
    pdf = b"%PDF-1.4\nx\nstartxref\n0\n%%EOF"
    ogg = b"OggS\0\4" + bytes(20) + b"\1\3abc"
    for data, kind in ((png(), "image/png"), (gif, "image/gif"), (jpeg, "image/jpeg"), (pdf, "application/pdf"), (ogg, "audio/ogg"), (z.getvalue(), "application/zip"), (media.wav(b"abc"), "audio/wav")):
        assert media.sniff(data, "text/plain")[:2] == (kind, len(data))
        assert media.sniff(b"junk " + data + b" tail", "text/plain") == ("text/plain", 0, [(kind, 5, len(data))])
        assert media.sniff(data[:-1], None)[0] in ("application/octet-stream",)
    assert media.sniff(b"RIFF GIF89a PK\3\4 %PDF-1.4\n OggS\0", "text/plain") == ("text/plain", 0, [])
    assert media.sniff(b"", None) == ("application/octet-stream", 0, [])


def test_sniffing_takes_whole_updated_pdfs_and_nested_archives():
    import io
    import zipfile

    def archive(data):
        z = io.BytesIO()
        with zipfile.ZipFile(z, "w") as f:
            f.writestr("a", data)
        return z.getvalue()

    pdf = b"%PDF-1.4\nx\nstartxref\n0\n%%EOF"
    updated = pdf + b"\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
    for data, kind in ((updated, "application/pdf"), (archive(archive("b")), "application/zip")):
        assert media.sniff(b"junk " + data + b" tail", "text/plain") == ("text/plain", 0, [(kind, 5, len(data))])
    assert [x[1:] for x in media.sniff(b"junk " + pdf + b"\n" + pdf, "text/plain")[2]] == [(5, len(pdf)), (6 + len(pdf), len(pdf))]


def test_recurring_magic_bytes_take_linear_time():
    mega = 1 << 20
    hostile = [b"PK\3\4" + bytes(26), b"%PDF-1.4\n", b"%PDF-1.4\n%%EOF", b"%PDF-1.4\nstartxref%%EOF\n", b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"!x\1a", b"GIF89a.......,.........", b"OggS\0" + bytes(21) + b"\1\0", b"PK\5\6" + bytes(18), b"RIFF    WAVE", b"\xff\xd8\xff\xda\0\2"]
    for unit in hostile:
        data = b"x" + unit * (2 * mega // len(unit))
        began = time.time()
        media.sniff(data, None)
        assert time.time() - began < 5, unit


def test_pdf_ends_equal_a_plain_walk():
    r = random.Random(2)

    def plain(b, at):
        last, k = None, at
        while (end := b.find(b"%%EOF", k)) >= 0 and (last is None or b.find(b"%PDF-", k, end) < 0):
            if b.find(b"startxref", k, end) >= 0:
                last = end + 5 - at
            k = end + 5
        return last

    for _ in range(400):
        data = b"".join(r.choice([b"%PDF-1.4\n", b"%%EOF", b"startxref", b"xy", b"%%EO"]) for _ in range(r.randint(1, 25)))
        seen_ = media.Seen(data)
        for m in re.finditer(rb"%PDF-1.4\n", data):
            assert media.valid_pdf(data, m.start(), seen_) == plain(data, m.start())


def test_media_edges(spark):
    got = {r.doc_id: r for r in media.read_media(media.store_texts(docs(spark, [(1, None), (2, ""), (3, "x" * 576), (3, "x" * 576), (4, media.wav(b"q" * 9).decode("latin-1"))]))).collect()}
    assert got[1].payload_sha256 == got[2].payload_sha256 == hashlib.sha256(b"\xff" * 576).hexdigest() and got[3].payload_bytes == 576
    assert media.read_media(media.store_texts(docs(spark, []))).count() == 0


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    all_docs = spark.read.parquet(f"{SF}/documents.parquet")
    crf = toxicity.train(all_docs, labels)
    bad = {r.doc_id for r in toxicity.score_documents(all_docs, crf).where("predicted = 1").collect()}
    clean = [(r["doc_id"], r["text"]) for r in rows(spark, "documents") if r["doc_id"] not in bad]
    comps = brute_components(clean)
    kept = [(i, t) for i, t in clean if comps[i][1] == i]
    hits = brute_hits(kept, [(r["item_id"], r["text"]) for r in rows(spark, "benchmark")])
    kept = [(i, pii.masked(t, pii.find_pii(t)[1])) for i, t in kept if not hits[i][4]]
    p = lattice.pieces_of(queries.model_path())
    got = {r.doc_id: r for r in c.run(spark, SF).collect()}
    assert set(got) == {i for i, _ in kept} and len(kept) < len(all_docs.collect())
    for i, t in kept[:40]:
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, brute_viterbi(p, t))).encode()).hexdigest()
    assert all(r.round_trip for r in got.values())


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline as c

    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "mail a@b.cd", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (odd, odd.limit(0)):
        for _, stage in c.STAGES[:-1]:
            assert set(stage(spark, frame, SF).columns) == set(c.COLUMNS)
            assert stage(spark, frame, SF).count() <= frame.count()
        assert c.STAGES[-1][1](spark, frame, SF).count() == frame.count()


def test_pipeline_keeps_rows_without_a_partner(spark):
    import corpus_pipeline as c

    base = " ".join(f"w{k}" for k in range(40))
    data = [(None, "alpha beta gamma"), (None, "delta epsilon zeta"), (None, base), (9, base + " more"), (8, base), (8, base), (7, "one text"), (7, "another text"), (5, ""), (5, ""), (None, None), (None, " \n")]
    frame = spark.createDataFrame([(i, t, None, "s", 1) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in c.keep_one_of_group(spark, frame, SF).collect()), key=str)
    assert got == sorted([data[0], data[1], data[4], *data[6:]], key=str)


def test_pipeline_judges_each_row_by_itself(spark, monkeypatch):
    import corpus_pipeline as c

    item = next(r["text"] for r in rows(spark, "benchmark") if len(decontaminate.words_of(r["text"])) >= 10)
    crf = toxicity.fit([(f"you idiot {k} go there b{k} c{k}", 1) for k in range(40)] + [(f"nice {k} day d{k} e{k} there", 0) for k in range(40)])
    monkeypatch.setattr(toxicity, "train", lambda *_: crf)
    frame = lambda data: spark.createDataFrame([(i, t, None, None, 1) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda d: sorted(((r.doc_id, r.text, r.n_chars) for r in d.collect()), key=str)
    clean = [(None, "nice day"), (-5, "nice day"), (-5, "nice day"), (None, None)]
    want = sorted(((i, t, 1) for i, t in clean), key=str)
    assert kept(c.drop_contaminated(spark, frame([*clean, (None, item), (-5, item)]), SF)) == want
    assert kept(c.drop_toxic(spark, frame([*clean, (None, "an idiot"), (-5, "an idiot")]), SF)) == want


def test_delta_prefixes_find_all_pairs_of_a_group():
    rng = np.random.default_rng(5)
    p = np.unique(rng.integers(1, 1 << 62, 120).astype(np.uint64))
    pool = np.unique(rng.integers(1, 1 << 62, 60).astype(np.uint64))
    found = 0
    for _ in range(3000):
        x = np.unique(np.concatenate([rng.choice(p, rng.integers(60, 121), replace=False), rng.choice(pool, rng.integers(0, 40), replace=False)]))
        y = np.unique(np.concatenate([rng.choice(x, len(x) - rng.integers(0, 20), replace=False), rng.choice(p, rng.integers(0, 12)), rng.choice(pool, rng.integers(0, 8))]))
        if not jaccard.similar(x, y, 75):
            continue
        (lx, _, tx, sx, wx), (ly, _, ty, sy, wy) = (jaccard.delta(z, p, 75) for z in (x, y))
        assert (lx, ly) == (jaccard.similar(x, p, 75), jaccard.similar(y, p, 75))
        if lx and ly:
            continue
        found += 1
        tx, ty = np.sort(tx), np.sort(ty)
        assert set(tx[:sx]) & set(ty[:sy]) if not (lx or ly) else set(tx[:wx]) & set(ty[:wy])
    assert found > 500


def test_jaccard_family_below_the_threshold(spark):
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(60):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(1, 9)), replace=False):
            words[at] = f"x{k}" if rng.random() < 0.7 else f"y{at}"
        texts.append((k, " ".join(words)))
    want = brute_components(texts)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.cluster(docs(spark, texts)).collect()} == {k: tuple(v) for k, v in want.items()}


def test_lattice_of_a_very_long_unit(spark, model):
    p = lattice.pieces_of(model)
    texts = [(1, "a" * 20_000), (2, "a" * 63), (3, "a" * 62), (4, "a" * 64), (5, "a" * 129 + "b" * 300 + " " + "a" * 129), (6, "é" * 5_000)]
    lattice.encode_texts(docs(spark, texts), model).count()
    began = time.time()
    got = lattice.encode_texts(docs(spark, texts), model, decoded_col="back").collect()
    assert time.time() - began < 30
    for r in got:
        assert r.back == r.text
        assert r.piece_ids == brute_viterbi(p, r.text)


def test_driver_gives_free_memory_of_the_c_library_back(spark):
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    resident = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) >> 10
    made = [jvm.java.util.zip.Deflater() for _ in range(300)]
    for k, x in enumerate(made):
        if k % 10:
            x.end()  # what stays keeps the pool from shrinking by itself
    before = resident()
    common.release_driver_memory(spark)
    freed = before - resident()
    for x in made[::10]:
        x.end()
    assert freed >= 20


def test_driver_gives_memory_back_after_each_table_and_fit(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release_driver_memory", calls.append)
    monkeypatch.setattr(toxicity, "release_driver_memory", calls.append)
    common.stored(spark.range(3), "t")
    assert len(calls) == 1
    toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert len(calls) == 2


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    assert got == sorted((tuple(r) for r in rel.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()), key=str) and got
