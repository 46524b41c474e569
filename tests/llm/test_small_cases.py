"""Every operator and stage on nulls, empty and long texts, ties, repeats, no rows, extra columns."""

from __future__ import annotations

import collections
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from echosieve.llm import (
    chat, decontaminate, html_extract, line_dedup, near_dedup, order_minhash, packing, quality,
    url_filter, warc,
)
from echosieve.llm.queries import CHAT_SCHEMAS, PACKING_RANKS, URL_RULES, tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_chars long, node long, id long, h string"


def word(i):
    return "".join(chr(ord("a") + int(c)) for c in str(i)) + "w"


LONG = " ".join(word(i % 997) + word(i % 29) for i in range(40_000))
BASE = " ".join(word(i) for i in range(60))
NEAR = BASE.replace(word(59), "other")

ROWS = [
    (1, BASE, "en", "a", 1, 1, 1, "x"),
    (2, BASE, "en", "a", 1, 1, 1, "x"),
    (2, BASE, "en", "a", 1, 1, 1, "x"),  # a repeated row
    (3, NEAR, None, None, None, None, None, None),
    (4, None, "en", "a", 0, 1, 1, "x"),
    (5, "", "en", None, 0, 1, 1, "x"),
    (6, " \n\t ", "en", "b", 4, 1, 1, "x"),
    (7, "Él año ÀB Éé", "es", "b", 1, 1, 1, "x"),
    (8, LONG, "en", "b", 1, 1, 1, "x"),
    (9, "one", "en", "b", 1, 1, 1, "x"),
    (None, "no id here at all", "en", "b", 1, 1, 1, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def shingles(text, size=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*[words[k:] for k in range(size)]))


def test_line_dedup(spark, docs, none, work):
    got = line_dedup.drop_lines(docs, work).collect()
    assert len(got) == len(ROWS) and {r["n_dropped"] for r in got} == {0}
    assert next(r for r in got if r["doc_id"] == 4)["text"] is None
    assert line_dedup.drop_lines(none, work).count() == 0
    pages = [(i, f"Menu \nown {i}\nMenu\n\nend", "h" if i % 3 else None) for i in range(60)]
    pages += [(100 + i, "Menu\nrare", "small") for i in range(4)]
    got = line_dedup.drop_lines(spark.createDataFrame(pages, "doc_id int, text string, source string"), work)
    for r in got.collect():
        if r["doc_id"] < 100:
            assert r["text"] == f"own {r['doc_id']}\n" and (r["n_lines"], r["n_dropped"]) == (5, 3)
        else:
            assert r["text"] == "Menu\nrare" and r["n_dropped"] == 0


@pytest.mark.parametrize("sent,hot", [(line_dedup.BROADCAST_BYTES, 20_000), (0, 20_000), (0, 7)])
def test_line_rule_holds_at_every_size(spark, work, sent, hot):
    pages, key = [], 0
    for size in (1, 2, 3, 4, 5, 20, 50, 200):
        for i in range(size):
            lines = [f"all {size}", f"own {size} {i}"]
            lines += [f"few {size} {n}" for n in (1, 2, 3, 4, 5, 6, 15, 16, 17) if i < n]
            pages.append((key, "\n".join(lines), None if size == 5 else f"h{size}"))
            key += 1
    pages += [(1000 + i, "held twice\nby a small host", "twin") for i in range(2)]
    counts, texts, total = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for _, text, host in pages:
        total[host] += 1
        for line in set(text.split("\n")):
            counts[host, line] += 1
            texts[host, line].add(text)

    def boilerplate(host, line):  # the textbook form of the bound
        n, p, z = total[host], counts[host, line] / total[host], line_dedup.Z
        low = (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
        return len(texts[host, line]) > 1 and low > line_dedup.RATIO

    df = spark.createDataFrame(pages, "_share int, text string, source string").repartition(3)
    got = line_dedup.drop_lines(df, work, broadcast_bytes=sent, hot_pages=hot)
    assert got.columns == ["_share", "text", "source", "n_lines", "n_dropped"]
    assert {r["_share"]: r["text"] for r in got.collect()} == {
        i: "\n".join(x for x in text.split("\n") if not boilerplate(host, x)) for i, text, host in pages}
    assert boilerplate("h2", "all 2") and not boilerplate("twin", "held twice")


def test_order_minhash(spark, docs, none, work):
    got = order_minhash.edited_fingerprints(docs, work).collect()
    assert len(got) == len(ROWS)
    by_text = {}
    texts = {r[0]: r[1] or "" for r in ROWS}
    order = sorted((k for k in texts if k is not None), reverse=True) + [None]
    for r in got:
        text, n = texts[r["doc_id"]], len(texts[r["doc_id"]])
        after = texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        edited = text[:n - n // 3] + after[:n // 3]
        import hashlib

        assert r["n_chars"] == n
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert order_minhash.edited_fingerprints(none, work).count() == 0
    forced = order_minhash.edited_fingerprints(docs, work, broadcast_bytes=0).collect()
    assert collections.Counter(forced) == collections.Counter(got)


def test_order_minhash_follows_a_plain_model(spark):
    texts = [BASE, "a b a b a b a b c", "one", "", "x " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = df.select(
        "i", order_minhash._kmers(F.col("text")).alias("k"),
        order_minhash.sketches(F.col("text")).alias("s"),
        F.transform(order_minhash._kmers(F.col("text")), lambda h: F.transform(
            F.sequence(F.lit(0), F.lit(60)), lambda c: F.xxhash64(h, c))).alias("g"),
    ).orderBy("i").collect()
    for row in out:
        seen, elements = collections.Counter(), []
        for at, h in enumerate(row["k"]):
            elements.append((row["g"][at][seen[h]] % (1 << 64), at, h))
            seen[h] += 1
        sketches = collections.defaultdict(list)
        for g, at, h in elements:
            sketches[g >> 58].append((g, at, h))
        kept = {n: [h for _, h in sorted((at, h) for _, at, h in sorted(own)[:2])]
                for n, own in sketches.items()}
        assert sorted(x % (1 << 32) >> 26 for x in row["s"]) == sorted(kept)
        assert len(row["s"]) == len(kept)
    moved = " ".join(word(i) for i in range(59, -1, -1))
    pair = spark.createDataFrame([(BASE, NEAR, moved)], "a string, b string, c string").select(
        *[order_minhash.sketches(F.col(c)).alias(c) for c in "abc"]
    ).select(order_minhash.likeness(F.col("a"), F.col("b")), order_minhash.likeness(F.col("a"), F.col("c")))
    near, far = pair.first()
    assert near > 0.8 and far < 0.2


def winnowed(docs, items):
    """Brute force for the contamination rule."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    out = []
    for key, text in docs:
        own, hit, ids = words(text), set(), set()
        for item, other in items:
            w = words(other)
            size = min(len(w), 13)
            for s in range(len(w) - size + 1) if w else []:
                for at in range(len(own) - size + 1):
                    if own[at:at + size] == w[s:s + size]:
                        hit.update(range(at, at + size))
                        ids.add("" if item is None else str(item))
        out.append((key, len(own), len(hit), len(ids)))
    return sorted(out, key=repr)


def test_contamination(spark, docs, none, work):
    span = " ".join(f"q{i}" for i in range(20))
    texts = [
        (1, f"{BASE} {span} {BASE}"), (2, span.upper()), (3, "q1 q2"), (4, None), (5, ""),
        (6, "a " * 200), (7, "short item here"), (8, "x short item here short item"), (9, "É é"),
        (10, " ".join(f"q{i}" for i in range(12))), (None, span), (1, span + " again"),
    ]
    items = [
        (1, span), (2, "a " * 40), (10, "Short item"), (3, None), (4, "..."), (5, "é"),
        (None, "q19"), (1, "here"), (6, " ".join(f"q{i}" for i in range(5, 20))),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("window_id", F.lit(1))
    want = winnowed(texts, items)
    for bound, hot in ((decontaminate.BROADCAST_BYTES, 100_000), (0, 100_000), (0, 1)):
        got = decontaminate.contamination(
            df, benchmark, work, broadcast_bytes=bound, hot_rows=hot).collect()
        rows = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in got), key=repr)
        assert rows == want
        assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in got)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, nothing, work).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(none, benchmark, work).count() == 0


def test_warc_round_trip(spark, work):
    big = "<p>" + "long é " * 300_000
    rows = [
        (3, "http://a/", "same"), (1, None, "same"), (2, "http://b/ \n", None), (4, "", ""),
        (5, "x", big), (6, "y", big), (None, "z", "same"), (7, "u", "one\r\n\r\ntwo"), (7, "u", "one\r\n\r\ntwo"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    archives = warc.write_archives(pages, work, archive_bytes=10_000)
    got = warc.read_archives(archives, keep_payload=True).collect()
    assert len(got) == len(rows) and all(r["digest_ok"] for r in got)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [
        (0, "revisit", 1), (1, "response", None), (2, "response", None), (3, "revisit", 1),
        (4, "revisit", 2), (5, "response", None), (6, "revisit", 5), (7, "response", None),
        (7, "response", None),
    ]
    sizes = {r["page_id"]: r["payload_bytes"] for r in got}
    assert sizes[6] == sizes[5] == len(big.encode()) and sizes[2] == sizes[4] == 0
    payload = {r["page_id"]: r["payload"] for r in got}
    assert payload[5] == big.encode() and payload[7] == b"one\r\n\r\ntwo" and payload[6] is None
    assert warc.read_archives(warc.write_archives(pages.limit(0), work)).count() == 0


@pytest.mark.parametrize("harm", ["cut", "digest", "longer"])
def test_warc_damage_is_seen(harm):
    import io

    data = bytearray(warc.record(1, "u", b"payload"))
    if harm == "digest":
        data = data.replace(b"payload", b"PAYLOAD")
    if harm == "longer":
        data += b"more"
    packed = warc.zlib.compressobj(6, zlib.DEFLATED, 31)
    member = packed.compress(bytes(data)) + packed.flush()
    stream = io.BytesIO(member[:-20] if harm == "cut" else member)
    read = lambda: [warc.read_record(p) for p in warc._members(stream)]
    if harm == "digest":
        assert read()[0][6] is False
    else:
        with pytest.raises(ValueError):
            read()


def test_html_blocks_and_extraction(spark):
    page = (
        "<html><head><title>T</title><script>var x='</p>';</script></head><body><nav><a href=x>Go</a></nav>"
        "<article><h1>Big &amp; <i>small</i></h1><p>One\n two &lt;b&gt; three, and a few more words."
        "<br>Next<p>Second paragraph, with words enough to be text.<div class='comments'><p>I think so"
        "</div></article><footer>&copy; me</footer>"
    )
    found = html_extract.blocks(page)
    assert [b.text for b in found][:3] == ["Go", "Big & small", "One two <b> three, and a few more words. Next"]
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<<<>>> no & tags"), (None, "u", page),
            (5, "u", "<p " + "x" * 100_000), (6, "u", "<p>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r["page_id"]: r for r in html_extract.main_text(df).collect()}
    want = ("Big & small\nOne two <b> three, and a few more words. Next\n"
            "Second paragraph, with words enough to be text.")
    assert got[1]["text"] == got[None]["text"] == want and got[1]["n_chars"] == len(want)
    assert got[2]["text"] == got[3]["text"] == ""
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_field_on_held_out_pages():
    import random

    rng = random.Random(1)
    pages = [html_extract.blocks(html_extract.made_page(rng)) for _ in range(120)]
    data = [(html_extract.features(p), [b.gold for b in p]) for p in pages]
    field = html_extract.Extractor(*html_extract.train(data))
    rng = random.Random(2)
    right = total = 0
    for _ in range(100):
        page = html_extract.blocks(html_extract.made_page(rng))
        labels = field.labels(page)
        right += sum(a == b.gold for a, b in zip(labels, page))
        total += len(page)
    assert right / total > 0.98


def test_viterbi_finds_the_best_labelling():
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(50):
        scores = [rng.uniform(-2, 2) for _ in range(6)]
        move = [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)]

        def value(labels):
            return sum(s for s, y in zip(scores, labels) if y) + sum(
                move[a][b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=6), key=value)
        assert html_extract.viterbi(scores, move) == list(best)


def test_tool_calls(spark, work):
    rows = [
        # id, conv, turn, role, kind, call_id, after, name, arguments, content, junk
        ("a", 1, 5, "assistant", "call", "k", "b", "reply", '{"words": 2, "prompt": "hi"}', None, 1),
        ("b", 1, 2, "tool", "result", "k0", None, None, None, "early", 1),
        ("c", 1, 3, "assistant", "call", "k0", None, "reply", '{"prompt": 1}', None, 1),
        ("d", 1, 1, "tool", "result", "k", None, None, None, "sooner than its call", 1),
        ("e", 1, 9, "tool", "result", "zz", None, None, None, None, 1),
        ("f", 1, 10, "assistant", "call", "k", None, "reply", "not json", None, 1),
        ("g", 2, 1, "assistant", "call", "k", None, "other", "{}", None, 1),
        ("h", 2, 2, None, None, None, "i", None, None, "cycle", 1),
        ("i", 2, 3, None, None, None, "h", None, None, "cycle", 1),
        (None, None, None, None, "call", None, None, None, None, None, None),
        ("j", None, 1, "assistant", "call", "n", None, "reply", '{"prompt": "x", "words": 1, "z": 1}', None, 1),
        ("k", None, 2, "tool", "result", "n", "missing", None, None, "r", 1),
    ]
    df = spark.createDataFrame(rows, (
        "id string, conv_id long, turn long, role string, kind string, call_id string, after string, "
        "name string, arguments string, content string, parent int"))
    got = {r["id"]: r for r in chat.link_tools(df, CHAT_SCHEMAS, work).collect()}
    assert len(got) == len(rows)
    assert {k: r["link"] for k, r in got.items()} == {
        "a": "answered", "b": "linked", "c": "answered", "d": "linked", "e": "orphan", "f": "repeated",
        "g": "unanswered", "h": None, "i": None, None: "unanswered", "j": "answered", "k": "linked",
    }
    assert [(r["ready_turn"], r["level"]) for k, r in sorted(got.items(), key=repr) if k in ("a", "b", "c", "d")] == [
        (5, 2), (3, 1), (3, 0), (5, 3)]
    assert got["h"]["level"] == got["i"]["level"] == -1
    assert got["a"]["arguments"] == "valid" and got["c"]["arguments"] == "prompt is not string"
    assert got["f"]["arguments"] == "not JSON" and got["g"]["arguments"] == "unknown tool"
    assert got["j"]["arguments"] == "unexpected z"
    assert got["a"]["json"] == (
        '{"arguments":{"prompt":"hi","words":2},"call_id":"k","kind":"call","name":"reply",'
        '"role":"assistant","turn":5}')
    assert chat.link_tools(df.limit(0), CHAT_SCHEMAS, work).count() == 0
    chain = [(f"n{i}", 1, 1000 - i, "r", "m", None, f"n{i - 1}", None, None, None, 1) for i in range(300)]
    deep = chat.link_tools(spark.createDataFrame(chain, df.schema), CHAT_SCHEMAS, work)
    assert {(r["level"], r["ready_turn"]) for r in deep.collect()} == {(i, 1000) for i in range(300)}


def test_packing(spark, docs, none, work):
    from tokenizers import Tokenizer

    got = packing.pack(docs, work, tokenizer_path(PACKING_RANKS)).collect()
    coder = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    ids = {r[0]: [*coder.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in ROWS}
    whole = collections.Counter()
    for r in got:
        own = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        data = b"".join(i.to_bytes(4, "little") for i in own)
        assert len(own) == r["length"] <= 2048 and zlib.crc32(data) == r["ids_crc32"]
        whole[r["doc_id"]] += r["length"]
    assert whole == {k: len(v) * sum(r[0] == k for r in ROWS) for k, v in ids.items()}
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got], 2048)
    assert packing.pack(none, work, tokenizer_path(PACKING_RANKS)).count() == 0


def check_sequences(placed, capacity):
    by = collections.defaultdict(list)
    for sequence, offset, length in placed:
        by[sequence].append((offset, length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_complete_and_tight(seed):
    import random

    rng = random.Random(seed)
    counts = collections.Counter(
        min(100, max(1, int(rng.paretovariate(1.1) * 8))) for _ in range(rng.choice((1, 30, 5000))))
    made = packing.plan(dict(counts), 100, 20)
    used = collections.Counter()
    for config, times in made.items():
        assert sum(config) <= 100 and times > 0
        for size in config:
            used[size] += times
    assert used == counts
    least = -(-sum(s * n for s, n in counts.items()) // 100)
    assert sum(made.values()) <= max(least * 1.02, least + 1) or seed == -1 or len(counts) < 3 or max(counts) > 50
    assert sum(made.values()) <= 1.1 * sum(packing.best_fit(counts, 100).values()) + 1


def test_cut_keeps_full_pieces_last():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(3, 4) == [(0, 3)] and packing.cut(4, 4) == [(0, 4)]


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "://", "http://NET/", "http://net", "http://a.b.Net/x?y", "http://xnet/",
        "https://example.net/en/1", "https://www.example.net/en", "https://example.com/de/#x",
        "http://q.org/fr/a", "http://org/fr/", "http://org/fr", "a://b://c/d", "http://é.net/ü", "x\n://net/a",
        "http://" + "a." * 300 + "net/" + "p" * 5000,
    ]
    df = spark.createDataFrame(
        [(i if i != 5 else None, u, "h") for i, u in enumerate(urls + urls[4:6])],
        "page_id long, url string, host string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = collections.Counter(map(tuple, url_filter.judge_urls(df, rules).collect()))

    def judge(i, url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in URL_RULES
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        return (i, host, path, best[1], best[2])

    assert got == collections.Counter(judge(r[0], r[1]) for r in df.collect())
    assert got == collections.Counter(map(tuple, url_filter.judge_urls(df, rules, sent_blocks=0).collect()))
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(df, rules.limit(0)).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives(spark):
    many = spark.range(5000).select(
        F.concat(F.lit("h"), "id").alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    pages = many.select(F.hash("host").cast("long").alias("page_id"), F.concat(F.lit("http://"), "host", F.lit("/x")).alias("url"))
    assert url_filter.judge_urls(pages, many, bits_per_rule=2).filter("verdict = 'allow'").count() == 0


def test_a_million_rules_keep_the_filter_selective(spark):
    rule = F.struct(F.concat(F.lit("h"), "id", F.lit(".net")).alias("host"), F.lit("/").alias("path"))
    rules = spark.range(1_000_000).select(rule.alias("r"), F.lit("block").alias("verdict")).select("r.*", "verdict")
    others = spark.range(1_000_000, 1_200_000).select(rule.alias("r")).select("r.*")
    assert url_filter.possible_hits(others, rules).count() < 0.05 * 200_000
    hosts = [(i, f"http://{'' if i % 2 else 'www.'}h{i * 5_000}.net/x") for i in range(400)]
    pages = spark.createDataFrame(hosts, "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {
        i: (f"h{i * 5_000}.net/", "block") if i * 5_000 < 1_000_000 else (None, "allow") for i, _ in hosts}


def near_groups(rows, percent=85):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    key = lambda x: (x is None, x)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    return sorted(
        ((r[0], len(sets[i]), min(groups[find(i)], key=key)) for i, r in enumerate(rows)), key=repr)


def test_near_duplicates(spark, docs, none, work):
    got = near_dedup.near_duplicates(docs, work)
    rows = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr)
    assert rows == near_groups(ROWS)
    assert near_dedup.near_duplicates(none, work).count() == 0


@pytest.mark.parametrize("options", [{}, {"small": 3, "broadcast_bytes": 0}])
def test_near_duplicates_in_large_groups(spark, work, options):
    import random

    rng = random.Random(4)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(220):  # copies with a few words changed, so some pairs are links and some not
        own = list(base)
        for at in rng.sample(range(120), rng.randint(0, 4)):
            own[at] = f"c{i}x{at}"
        rows.append((1000 - i, " ".join(own)))
    chain = [f"k{i}" for i in range(150)]
    for i in range(12):  # each a link of the one before only
        rows.append((2000 + i, " ".join(chain[5 * i:5 * i + 95])))
    for i in range(60):  # unlike texts that share a passage
        rows.append((3000 + i, " ".join([f"u{i}y{k}" for k in range(40)] + base[:30])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, work, **options)
    rows_got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr)
    assert rows_got == near_groups(rows)


@pytest.mark.parametrize("size", [300, 800, 3000])
def test_families_around_the_threshold(spark, work, size, monkeypatch):
    """Of 200 words each text has four others, so few pairs are links: none of them is lost, and
    no step writes more rows than a fixed number for each text."""
    import random

    import numpy as np

    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    kept = np.ones((size, 198), np.int32)
    rows = []
    for i in range(size):
        own = list(base)
        for at in rng.sample(range(200), 4):
            own[at] = f"o{i}x{at}"  # found in no other text
            kept[i, max(0, at - 2):at + 1] = 0
        rows.append((i, " ".join(own)))
    common = kept @ kept.T
    linked = np.argwhere(np.triu(common * 100 >= (2 * 198 - common) * 85, 1))
    parent = list(range(size))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 40_000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = near_dedup.near_duplicates(df, work)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: top(i) for i in range(size)}
    assert len(linked) >= size // 10
    for table in work.tables:
        assert spark.read.parquet(table).count() <= 40 * size, table


@pytest.mark.parametrize("narrow", [near_dedup.NARROW, 0x3F])
def test_tiles_take_narrow_sets_and_full_sets_confirm(spark, work, monkeypatch, narrow):
    """With six bits of a hash hardly any link of a tile holds, and still none is lost; only the
    sets of the links that were found are written, not those of whole families."""
    import random

    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        own = list(base)
        for at in rng.sample(range(200), 4):
            own[at] = f"o{i}x{at}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(near_dedup, "NARROW", narrow)
    ids, links, again = [], [], []
    sets, verify, linked = near_dedup._Join.sets, near_dedup._Join.verify, near_dedup._Join.linked
    compare, inside = near_dedup._Join.compare, []

    def recorded(self, centred):
        inside.append(1)
        compare(self, centred)
        inside.pop()

    monkeypatch.setattr(near_dedup._Join, "compare", recorded)
    monkeypatch.setattr(near_dedup._Join, "sets", lambda self, x: (
        inside and ids.append(x.count()), sets(self, x))[1])
    monkeypatch.setattr(near_dedup._Join, "verify", lambda self, x: (
        inside and links.append(x.count()), verify(self, x))[1])
    monkeypatch.setattr(near_dedup._Join, "linked", lambda self, x, narrow: (
        again.append(narrow), linked(self, x, narrow))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, work)
    rows_got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr)
    assert rows_got == near_groups(rows)
    assert again and (False in again) == (narrow == 0x3F)
    assert len(ids) == len(links) and sum(ids) <= 2 * sum(links)


@pytest.mark.parametrize("percent", [50, 80])
def test_near_duplicates_at_other_similarities(spark, work, percent):
    rows = []
    for i in range(150):  # pairs just above the threshold: of 100 words a run is replaced
        own = [f"p{i}x{k}" for k in range(100)]
        run = 32 if percent == 50 else 8
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:60] + ["new"] * run + own[60 + run:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, work, percent=percent)
    rows_got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr)
    want = near_groups(rows, percent)
    assert sum(a != c for a, _, c in want) == 150
    assert rows_got == want


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_components_write_no_round_that_changes_nothing(spark, work, most):
    """A star is done after its first round; with labels that are sent, a round has one shuffle."""
    from echosieve.llm.components import components

    def found(pairs):
        links = work.table(spark.createDataFrame(pairs, "a long, b long"), "links")
        before = len(work.tables)
        got = components(links, work, most)
        return {r["id"]: r["component"] for r in got.collect()}, len(work.tables) - before

    star, tables = found([(50, i) for i in range(100)] + [(50, 3)])
    assert star == dict.fromkeys(range(100), 0) and tables == 2
    chain, tables = found([(i, i + 1) for i in range(40)] + [(90, 91), (91, 91)])
    assert chain == dict.fromkeys(range(41), 0) | {90: 90, 91: 90} and tables < 12


def test_near_duplicates_write_no_ids_and_send_leaders(spark, work):
    """Ids of pairs go to the texts as they are, and the few leaders to the rows of their nodes."""
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[:99], f"o{i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, work)
    assert {r["component_id"] for r in got.collect()} == {0}
    names = [t.rsplit("-", 1)[1] for t in work.tables]
    assert "ids" not in names and "leaders" in names


def test_near_duplicates_write_small_tables_by_few_tasks(spark, work):
    """Many shuffle partitions, which nothing merges, do not make as many tasks and files of a
    small table; a large one keeps them."""
    import os

    from echosieve.llm.common import few_tasks
    from echosieve.llm.components import components

    files = lambda t: len([f for f in os.listdir(t.removeprefix("file:")) if f.endswith(".parquet")])
    many = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    cores = spark.sparkContext.defaultParallelism
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 4000, 2)], "a long, b long")
        links = work.table(pairs, "links")
        for most in (0, 1 << 20):
            first = len(work.tables)
            got = components(links, work, most)
            assert {(r["id"], r["component"]) for r in got.collect()} == {
                (i, i - i % 2) for i in range(4000)
            }
            assert all(files(t) <= cores for t in work.tables[first:])
        dealt = pairs.groupBy("a").count()
        assert few_tasks(dealt, 1 << 30, 24).rdd.getNumPartitions() == 61
        # Texts in pairs that are links, and a group with one word changed in each.
        base = [f"w{i}" for i in range(100)]
        rows = [(2 * i + k, " ".join(f"d{i}x{j}" for j in range(100 + k))) for i in range(60) for k in (0, 1)]
        rows += [(1000 + i, " ".join([*base[:99], f"o{i}"])) for i in range(60)]
        first = len(work.tables)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), work)
        assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {
            (i, 1000 if i >= 1000 else i - i % 2) for i, _ in rows
        }
        small = [t for t in work.tables[first:] if t.rsplit("-", 1)[1] in (
            "classes", "nodes", "pairs", "best", "links", "labels", "leaders", "led"
        )]
        assert len(small) > 8 and all(files(t) <= cores for t in small)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_least_agreeing_follows_the_similarity():
    assert [near_dedup.least_agreeing(p) for p in (50, 80, 85, 100)] == [18, 38, 42, 64]


def test_features_take_letters_from_whole_texts(spark):
    """One pattern a text instead of one a word, and the words stay in line with it."""
    import re

    texts = ["", " ", None, "  a  b ", "ABC 'Abc' ABC! x", "| || | -- a-b|c", "don't re-enter",
             "\t\nfoo\x0bBAR\x0cbaz\rQUX", "sentences sentences sentence", "(((x))) y1 2z 33"]
    column = quality.features(F.col("text"))
    assert "regexp_replace(lower(array_join(" in str(column)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in df.select("text", column.alias("f")).collect():
        t = (r["text"] or "").split()
        w = [re.sub("[^a-z]", "", x.lower()) for x in t]
        f = r["f"]
        assert (f["n"], len(f["words"])) == (len(t), sum(x != "" for x in w))
        assert len(f["prefixes"]) == sum(len(x) > quality.PREFIX for x in w)
        assert f["symbols"] == sum(len(x) - len(y) > 1 for x, y in zip(t, w))
        assert f["caps"] == sum(x.upper() == x != x.lower() and len(x) > 2 for x in t)
        assert f["bars"] == t.count("|")
        assert f["repeats"] == sum(a == b for a, b in zip(t, t[1:]))
        assert f["alike"] == len(f["words"]) - len(set(f["words"]))


def test_quality(spark, docs, none, work):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (2, None, 1), (None, 0, 0), (8, 0, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels, work).collect()
    assert len(got) == len(ROWS) and all(0 <= r["junk_score"] <= 1 for r in got)
    assert all(r["accepted"] for r in got if r["doc_id"] in (4, 5, 6))
    assert quality.classify(docs, labels.limit(0), work).count() == len(ROWS)
    assert quality.classify(none, labels, work).count() == 0


def test_label_model_recovers_accuracies():
    import numpy as np

    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.15
    rates = [(0.7, 0.02), (0.5, 0.05), (0.9, 0.01)]
    votes = np.stack([np.where(rng.random(len(truth)) < np.where(truth, h, a), 2, 1) for h, a in rates], 1)
    known = np.where(rng.random(len(truth)) < 0.3, np.where(truth, 2, 1), 0)
    patterns, counts = np.unique(np.column_stack([votes, known]), axis=0, return_counts=True)
    _, (share, hits, alarms) = quality.expectation_maximisation(patterns, counts)
    assert abs(share - 0.15) < 0.01
    assert all(abs(h - r[0]) < 0.03 and abs(a - r[1]) < 0.01 for h, a, r in zip(hits, alarms, rates))


def test_quality_on_held_out_labels(spark, work):
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(documents, labels.filter("doc_id % 3 != 0"), work)
    held = model.score(documents.join(labels.filter("doc_id % 3 = 0"), "doc_id"), "text", "s")
    rows = held.select("quality", "toxic", "s.junk", F.col("s.toxic").alias("st")).collect()
    right = sum(((r["junk"] >= 0.5) == (r["quality"] == 0)) for r in rows)
    assert right / len(rows) > 0.95
    clean = [r for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(r["junk"] >= 0.5 or r["st"] >= 0.5 for r in clean) <= 0.02 * len(clean)


def test_stages(spark, docs, none, tmp_path):
    for table, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        rows = [(i, 1, 0) for i in (1, 7, 8, 9)] if table == "labels" else [(1, "one")]
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    for start in (docs, none):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, now, str(tmp_path))
            assert after.columns == docs.columns
            now = after
        packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        left = {r["doc_id"] for r in now.collect()}
        assert {r["doc_id"] for r in packed.collect()} == left
        if start is docs:
            assert left == {1, 4, 5, 6, 7, 8, None}  # 2 and 3 copy 1; 9 is a benchmark item


def test_line_stage_takes_effect(spark, tmp_path):
    pages = [(i, f"Menu\nown {i}", "en", "h", 10) for i in range(40)]
    df = spark.createDataFrame(pages, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.line_stage(spark, df, str(tmp_path)).collect()
    assert all(r["text"] == f"own {r['doc_id']}" and r["n_chars"] == len(r["text"]) for r in got)


def test_packing_ids_are_those_of_the_named_tokenizer():
    from tokenizers import Tokenizer

    encode = packing._encoder(tokenizer_path(PACKING_RANKS))
    coder = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "x  <|endoftext|><|endoftext|>  y\n\n", "<|<|endoftext|>|>", "<|endoftext", " " * 10**6 + "b"]
    for text in texts:
        assert encode(text) == coder.encode(text, add_special_tokens=False).ids
    assert encode(texts[0]) == [64, 220, 50256, 275]


def test_packing_keeps_added_tokens_whole(spark, work):
    df = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    row = packing.pack(df, work, tokenizer_path(PACKING_RANKS)).first()
    data = b"".join(i.to_bytes(4, "little") for i in (64, 220, 50256, 275, 0))
    assert (row["length"], row["ids_crc32"]) == (5, zlib.crc32(data))


@pytest.mark.parametrize("times", [10**3, 10**9])
def test_best_fit_sees_a_bounded_number_of_pieces(monkeypatch, times):
    import random

    rng = random.Random(5)
    counts = collections.Counter(min(100, max(1, int(rng.paretovariate(1.1) * 8))) for _ in range(5000))
    counts = collections.Counter({s: n * times + s for s, n in counts.items()})
    seen, plain = [], packing.best_fit

    def watched(pieces, capacity):
        seen.append(pieces.total())
        assert seen[-1] <= packing.LEFT * capacity
        return plain(pieces, capacity)

    monkeypatch.setattr(packing, "best_fit", watched)
    shared = packing.in_shares(counts, 100)
    made = packing.plan(dict(counts), 100, 20)
    for plan in (shared, made):
        used = collections.Counter()
        for config, n in plan.items():
            assert sum(config) <= 100 and n > 0
            for size in config:
                used[size] += n
        assert used == counts
    least = -(-sum(s * n for s, n in counts.items()) // 100)
    assert sum(made.values()) <= 1.02 * least


def test_near_stage_finds_copies_changed_in_one_run(spark, tmp_path):
    rows = []
    for i in range(4):
        own = [f"s{i}x{k}" for k in range(100)]
        rows.append((10 * i, " ".join(own)))
        rows.append((10 * i + 1, " ".join(own + [f"tail{k}" for k in range(20)])))  # 96 / 116
        rows.append((10 * i + 2, " ".join(own[:50] + [f"new{k}" for k in range(40)] + own[50:])))
        own = [f"r{i}x{k}" for k in range(100)]
        rows.append((10 * i + 5, " ".join(own)))
        rows.append((10 * i + 6, " ".join(own[:40] + [f"run{k}" for k in range(6)] + own[46:])))  # 86 / 106
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.near_stage(spark, df, str(tmp_path)).collect()}
    assert left == {10 * i + k for i in range(4) for k in (0, 2, 5)}


def test_columns_named_like_helpers(spark, work):
    names = "_host _lines _new _f _score _k _c host lines keys total line pages id sh n node h1 row"
    rows = [(i, f"Menu\nown words {i}", "h", *["v"] * len(names.split())) for i in range(12)]
    df = spark.createDataFrame(
        rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names.split())
    )
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    got = line_dedup.drop_lines(df, work)
    assert {r["n_dropped"] for r in got.collect()} == {1} and got.columns[:len(df.columns)] == df.columns
    got = quality.classify(df, labels, work)
    assert got.count() == 12 and set(df.columns) <= set(got.columns)


def test_deep_and_unclosed_elements_take_memory_by_the_page():
    import tracemalloc

    from echosieve.llm.html_blocks import blocks

    field = html_extract.Extractor({"tag:div": 0.5, "tag:b": 0.5}, [[0.0, 0.0], [0.0, 0.0]])
    pages = {
        "<div>a" * 100_000: 100_000, "<b>" * 50_000 + "<p>x" * 20_000: 20_000,
        "".join(f"<div class=c{i}>a" for i in range(50_000)): 50_000,
        "<div>" * 20_000 + "<li>q" * 20_000: 20_000,
    }
    for page, found in pages.items():
        tracemalloc.start()
        parsed = blocks(page)
        assert len(parsed) == found and sum(field.labels(parsed)) >= found - 1
        assert tracemalloc.get_traced_memory()[1] < 300e6
        tracemalloc.stop()
    path = parsed[-1].element.path()
    assert (len(path), path[-1].tag, path[-1].inner) == (20_001, "li", "li")
