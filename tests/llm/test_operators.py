"""The corpus operators against brute force, round trips and odd input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshvoyage.llm import chat, components, decontam, dedup, htmltext, jaccard, langid, linededup, packing, pagemaker, storage, urlfilter, warc
from meshvoyage.llm.queries import MARKED, RULES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, node string, a string, digest string, component string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", None, "y", "z", 1) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    """Documents with copies, near copies, repeated lines, nulls, empty and very long texts."""
    r = random.Random(4)
    words = ["w" + "".join(r.choices("abcdefg", k=3)) for _ in range(300)]
    rows = [(i, " ".join(r.choices(words, k=r.choice((0, 1, 3, 8, 40, 120)))), r.choice(("en", "fr", None))) for i in range(60)]
    base = " ".join(r.choices(words, k=200)).split()
    for i in range(60, 80):
        own = base[:]
        own[r.randrange(200)] = "Changed" + str(i)
        rows.append((i, " ".join(own), "en"))
    line = "  This very line repeats in MANY documents \t"
    rows += [(80, line + "\nown a", "en"), (81, "x\n" + line.upper() + "\n" + line, "en"), (82, line, "fr"), (83, "x\n\n", None)]
    rows += [(90, None, "en"), (91, "", "en"), (92, "12 34 !", "en"), (93, "é " * 30000, "fr"), (94, rows[5][1], "en"), (95, rows[5][1], "en"), (None, "lonely text of nobody", None), (96, "same row", "en"), (96, "same row", "en")]
    return rows


EMPTY: list = []


def test_exact_dedup(spark, texts):
    rows = dedup.exact_duplicates(frame(spark, texts)).collect()
    groups = {}
    for i, t, _ in texts:
        groups.setdefault(t or "", []).append(i)
    assert len(rows) == len(texts)
    keep = {hashlib.sha256(t.encode()).hexdigest(): (max((x for x in ids if x is not None), default=None), len(ids)) for t, ids in groups.items()}
    assert all((r.keep_id, r.group_size) == keep[r.text_sha256] for r in rows)
    assert sum(r.kept for r in rows) == len(groups)
    kept = dedup.drop_exact_duplicates(frame(spark, texts))
    assert kept.columns == frame(spark, EMPTY).columns and kept.count() == len(groups)
    assert dedup.exact_duplicates(frame(spark, EMPTY)).count() == 0


def test_line_dedup(spark, texts):
    rows = {(r.doc_id, r.text): r for r in linededup.dedup_lines(frame(spark, texts)).collect()}
    by_id = {i: r for (i, _), r in rows.items()}
    assert by_id[80].text == "own a" and by_id[81].text == "x" and by_id[81].n_dropped == 2 and by_id[82].n_dropped == 0
    assert by_id[90].text is None and by_id[90].n_lines == 1 and by_id[83].text == "x\n\n"
    assert linededup.dedup_lines(frame(spark, EMPTY)).count() == 0


def test_packing_is_whole_and_gapless(spark, texts):
    own = packing.WordTokenizer(tokenizer_path())
    pieces = packing.pack(frame(spark, texts), tokenizer_path(), window=64, digests=True).collect()
    back, at = {}, {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert at.get(p.sequence_id, 0) == p.offset and p.ids_crc32 == zlib.crc32(p.ids)
        at[p.sequence_id] = p.offset + p.length
    assert sum(v != 64 for v in at.values()) <= 1
    for p in sorted(pieces, key=lambda p: p.start):
        if p.doc_id not in (96, None):
            back[p.doc_id] = back.get(p.doc_id, b"") + p.ids
    for i, t, _ in texts:
        if i in back:
            assert back[i] == own.ids(t or "") + np.array([1], "<u4").tobytes()
    assert packing.pack(frame(spark, EMPTY), tokenizer_path()).count() == 0


def test_word_tokenizer_matches_the_library():
    own, r = packing.WordTokenizer(tokenizer_path()), random.Random(2)
    odd = ["", " ", "It's we'll 12 3.5 <|endoftext|> ΣΑΣ İx ½ \x00\x1c\x85b", "don'T…日本"] + ["".join(chr(r.choice((r.randrange(32, 127), r.randrange(0, 0x3FF), r.randrange(0x2000, 0x2100), 32))) for _ in range(20)) for _ in range(200)]
    for t in odd:
        assert own.ids(t) == np.array(own.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())


def test_decontamination(spark, texts):
    items = [(1, " ".join(texts[60][1].split()[20:60])), (2, texts[82][1]), (3, "lonely text"), (4, None), (5, ""), (1, " ".join(texts[60][1].split()[20:60])), (None, "own a")]
    rows = decontam.contamination(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).add("" if i is None else str(i))
    expected = []
    for i, t, _ in texts:
        w = words(t)
        hit, found = [0] * len(w), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    found |= wins[tuple(w[k : k + n])]
                    hit[k : k + n] = [1] * n
        n = sum(hit)
        expected.append((i, len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)[:6]) for r in rows)
    assert sum(r.contaminated for r in rows) > 20
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontam.contamination(frame(spark, texts), none).where("contaminated").count()
    assert decontam.contamination(frame(spark, EMPTY), none).count() == 0


def test_language_id(spark):
    r = random.Random(1)
    french, english = "le la et une avec être déjà garçon".split(), "the and with been already boy which".split()
    rows = [(i, " ".join(r.choices(french if i % 2 else english, k=20)), "fr" if i % 2 else "en") for i in range(80)] + [(100, None, "en"), (101, "12 !", "fr"), (102, "garçons", None), (None, "le garçon", None)]
    got = {x.doc_id: x for x in langid.identify(frame(spark, rows)).collect()}
    assert all(got[i].lang_pred == ("fr" if i % 2 else "en") for i in range(80))
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[102].lang_pred == "fr"
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 for i in range(80))
    assert [x.lang_pred for x in langid.identify(frame(spark, [(1, "abc", None)])).collect()] == ["und"]
    assert langid.identify(frame(spark, EMPTY)).count() == 0


@pytest.mark.parametrize("batch", [10_000, 3])
def test_jaccard_join(spark, texts, monkeypatch, batch):
    """Against all pairs; small blocks, and many batches, each with stars of its own."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rows = [x for x in texts if x[0] is not None and x[0] != 96]
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    changed = True
    pairs = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            low = min(comp[i], comp[j])
            changed |= comp[i] != low or comp[j] != low
            comp[i] = comp[j] = low
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame(spark, texts)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert all(got[i] == (len(sets[i]), comp[i]) for i in sets) and got[None][1] is None
    assert len(set(comp.values())) < len(comp) - 15
    assert jaccard.near_duplicates(frame(spark, EMPTY)).count() == 0


def test_signatures_keep_the_pigeonhole():
    """Every similar pair shares a signature, in both allocations."""
    r, share = np.random.default_rng(3), jaccard.Fraction(4, 5)
    plans = [(k, s, kind, n) for k, s in enumerate(jaccard.bands(share, 400)) for kind, n in [jaccard.allocate(s, 10**6 if k % 2 else 10, share)]]
    for size in (1, 2, 4, 5, 7, 9, 20, 33, 64, 150, 300):
        for _ in range(20):
            a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
            drop = int(r.integers(0, max(1, size // 8) + 1))
            b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**63, int(r.integers(0, 3)) if size > 20 else 0).astype(np.uint64)]))
            if len(b) and 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
                one, two = (np.concatenate(jaccard._signatures(x, plans, share)) for x in (a, b))
                assert len(np.intersect1d(one, two)), size


def test_signatures_stay_few_in_large_tables():
    """A band of many sets once wrote a signature for each shingle: disk beyond the limit at 6 GB."""
    share = jaccard.Fraction(4, 5)
    for span in jaccard.bands(share, 20_000):
        for sets in (10, 10**6, 10**9):
            kind, segments = jaccard.allocate(span, sets, share)
            rows = segments + (sum(span) // 2 if kind == "deletion" else 0)
            assert rows <= 2 * (jaccard.differing(span[1], span[1], share) + 4), (span, sets)


def test_one_deletion_neighbourhoods_keep_the_pigeonhole():
    """Similar sets share a signature where neighbourhoods are taken, at a threshold that takes them by cost too."""
    r = np.random.default_rng(4)
    assert any(jaccard.allocate(s, 10**6, jaccard.Fraction(1, 2))[0] == "deletion" for s in jaccard.bands(jaccard.Fraction(1, 2), 400))
    for share in (jaccard.Fraction(4, 5), jaccard.Fraction(1, 2)):
        plans = [(k, s, "deletion", (jaccard.differing(s[1], s[1], share) + 2) // 2) for k, s in enumerate(jaccard.bands(share, 400))]
        for size in (1, 2, 4, 5, 7, 9, 20, 33, 64, 150, 300):
            for _ in range(20):
                a = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
                b = np.unique(np.concatenate([a[int(r.integers(0, size // 4 + 1)) :], r.integers(0, 2**63, int(r.integers(0, size // 4 + 1))).astype(np.uint64)]))
                if share.denominator * len(np.intersect1d(a, b)) >= share.numerator * len(np.union1d(a, b)):
                    one, two = (np.concatenate(jaccard._signatures(x, plans, share)) for x in (a, b))
                    assert len(np.intersect1d(one, two)), size


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_jaccard_join_in_rounds(spark, monkeypatch, tmp_path, threshold):
    """Blocks that travel in many rounds find every link, and little stays on disk."""
    for name, value in (("BLOCK", 8), ("ROUND_SHINGLES", 1), ("ROUND_SHARE", 0.5)):
        monkeypatch.setattr(jaccard, name, value)
    r, rows = random.Random(8), []
    for family in range(3):
        base = [f"w{r.randrange(10**6)}" for _ in range(60)]
        for k in range(9):  # a head that all have, and bodies of two kinds
            body = base[:] if k % 2 else base[:25] + [f"v{family}"] * 3 + [f"u{r.randrange(10**6)}" for _ in range(32)]
            body[r.randrange(60)] = f"x{k}"
            rows.append((family * 9 + k, " ".join(["common"] * 4 + ["a b c d e f g h"] + body), "en"))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t, _ in rows for w in [t.split()]}
    comp = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(frame(spark, rows), threshold=threshold).collect()}
    assert got == {i: (len(s), comp[i]) for i, s in sets.items()}
    kinds = [p.name.split("-")[0] for p in (tmp_path / "llm").iterdir()]
    assert kinds.count("more") > 1 and not {"own", "stars", "candidates", "pairs", "units"} & set(kinds)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (None, 3), (200, 100)]
    got = dict(tuple(x) for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}


def test_chat_reads_back(spark):
    r = random.Random(5)
    turns = [(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED), (1, 0, None, None), (2, 0, "assistant", "<turn x>\n&lt; </turn>\n"), (2, 0, "assistant", "<turn x>\n&lt; </turn>\n"), (None, 1, "user", "hi")]
    turns += [(3, 0, "system", "be < kind &amp;")] + [(3, i, "user" if i % 2 else "assistant", " ".join(r.choices(["a", "b>", "c&"], k=r.choice((1, 30, 90))))) for i in range(1, 60)]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_windows(df, budget=300, history=60)
    assert windows.where("conv_id = 3").count() > 5 and windows.where("conv_id = 3 AND window > 0 AND NOT text LIKE '<turn system>%'").count() == 0
    got = {x.conv_id: x for x in chat.read_back(windows).collect()}
    for c in {t[0] for t in turns}:
        own = sorted(((t or 0, role or "", text or "") for k, t, role, text in turns if k == c))
        loss = "".join(x for _, role, x in own if role == "assistant")
        told = "".join(f"{role}\n{x}\n" for _, role, x in own)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


def test_chat_digest_covers_windows_that_repeat_turns(spark):
    turns = [(1, 0, "system", "rule")] + [(1, i, "user" if i % 2 else "assistant", f"word{i} " * 20) for i in range(1, 40)]
    windows = chat.format_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), budget=300, history=90)
    assert windows.where("n_repeated >= 2").count() > 1
    told = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
    assert chat.read_back(windows).first().turns_sha256 == hashlib.sha256(told.encode()).hexdigest()


def test_url_filter_carries_blocks_to_aliases(spark):
    link = '<LINK href="{}" rel="canonical"><!-- <link rel=canonical href="https://q.example.net/z"> -->'
    pages = [
        (1, "https://A.example.com/de/1#x", None), (2, "https://b.example.net/x", link.format("https://a.example.com/de/1")), (3, "https://c.example.net/y", "<meta http-equiv=refresh content='0; url=//b.example.net/x'>"),
        (4, "https://d.example.net/1", link.format("https://a.org/k")), (5, "https://e.example.net/1", link.format("https://d.example.net/1") + link.format("https://x.com/de/9")), (6, None, None), (7, "nothing", ""), (8, "https://a.example.org/es/2?q", ""),
        (9, "https://a.example.org/en/12", ""), (10, "https://notorg/", ""), (11, "https://f.example.net/", link.format("g")), (12, "https://q.example.net/z", ""),
    ]
    df = spark.createDataFrame([(*p, "h", "v") for p in pages], "page_id long, url string, html string, host string, component string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, RULES).collect()}
    assert got[1] == ("a.example.com", "/de/1", "com/de/", "block") and got[2][3] == "block" and got[3][3] == "block"
    assert got[4][3] == got[5][3] == "allow" and got[6] == ("", "", None, "allow") == got[7]
    assert got[8][2:] == ("example.org/es/", "block") and got[9][2:] == ("example.org/en/1", "block") and got[10][2] is None and got[11][3] == got[12][3] == "allow"
    assert urlfilter.judge(df.limit(0), RULES).count() == 0


def test_many_rules_join_like_few(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"https://h{i % 5}.example.{t}/{p}/1", None) for i, (t, p) in enumerate((t, p) for t in ("org", "com", "net") for p in ("es", "en", "de", "fr"))], "page_id long, url string, html string")
    few = sorted(map(tuple, urlfilter.judge(df, RULES).drop("html").collect()))
    monkeypatch.setattr(urlfilter, "INLINE_RULES", 0)
    assert sorted(map(tuple, urlfilter.judge(df, RULES).drop("html").collect())) == few


def test_html_text(spark):
    page = '<html><body><nav><ul><li><a href=/x>Home</a></li><li><a href=/y>News</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>Title &amp; more</h1><p>First  paragraph,\n with <b>bold</b> words and a line<br>break in it.</p><p>Second paragraph of the text follows here.</article><div id="comments"><p>I like it.</p></div><footer>&copy; me</footer><script>var a="<p>no</p>"</script></body></html>'
    rows = [(1, page), (2, None), (3, ""), (4, "<<p <b"), (5, "<div>" * 3000 + "deep")]
    got = {r.page_id: r for r in htmltext.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, html string, text string")).collect()}
    assert got[1].text == "Title & more\n\nFirst paragraph, with bold words and a line break in it.\n\nSecond paragraph of the text follows here."
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == "" and len(got) == 5


def test_html_text_on_pages_not_trained_on():
    trees, exact = htmltext.model(), 0
    for source in pagemaker.pages(100, seed=99):
        page = htmltext.Page(source)
        main = [False] * len(page.parent)
        for node, piece, _ in page.pieces:
            main[node] |= pagemaker.MARK in piece
        expected = htmltext.text_of(page, main).replace(pagemaker.MARK, "")
        page.pieces = [(n, t.replace(pagemaker.MARK, ""), f) for n, t, f in page.pieces]
        exact += htmltext.text_of(page, htmltext.decode(page, trees.score(htmltext.features([page])))) == expected
    assert exact >= 90


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", "<p>Hi &amp; <b>you</b></p><script>x</script><p>two"), (2, None, None)], "page_id long, url string, html string")
    records = warc.derivatives(warc.responses_of(pages))
    rows = records.collect()
    assert len(rows) == 4 and {r.record_type for r in rows} == {"metadata", "conversion"}
    text = next(r for r in rows if r.record_type == "conversion" and r.key == "1")
    about = next(r for r in rows if r.record_type == "metadata" and r.key == "1")
    assert bytes(text.block).decode() == "Hi & you\ntwo" and text.refers_to == about.refers_to and text.record_id in bytes(about.block).decode()
    assert text.payload_digest == warc.digest(b"<p>Hi &amp; <b>you</b></p><script>x</script><p>two")
    archive = b"".join(bytes(r.member) for r in warc.to_members(records).collect())
    back = list(warc.parse(archive))
    assert len(back) == 4 and {r["refers_to"] for r in back} == {r.refers_to for r in rows}
    assert all(r["fields"]["WARC-Block-Digest"] == warc.digest(r["block"]) for r in back)
    assert warc.derivatives(warc.responses_of(pages.limit(0))).count() == 0


def test_warc_reader_keeps_payloads_and_digests(spark, tmp_path):
    import gzip

    page = "<p>Füße</p>".encode("latin-1")
    packed = gzip.compress(page, mtime=0)
    bodies = [(b"Content-Type: text/html; charset=ISO-8859-1", page), (b"Content-Type: text/html; charset=ISO-8859-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked", b"%x\r\n" % len(packed) + packed + b"\r\n0\r\n\r\n")]
    archive = b""
    for i, (head, body) in enumerate(bodies):
        block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body
        fields = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:{i}>\r\nWARC-Target-URI: https://a.example/{i}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:PAYLOAD{i}\r\nWARC-Block-Digest: sha1:BLOCK{i}\r\nContent-Length: {len(block)}\r\n\r\n"
        archive += fields.encode() + block + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(archive)
    responses = warc.read_responses(spark, str(tmp_path))
    assert [bytes(r.payload) for r in responses.orderBy("record_id").collect()] == [b for _, b in bodies]
    for r in warc.derivatives(responses).collect():
        i = r.refers_to[-2]
        assert r.payload_digest == f"sha1:PAYLOAD{i}"
        if r.record_type == "conversion":
            assert bytes(r.block).decode() == "Füße"
        else:
            assert f"source-block-digest: sha1:BLOCK{i}" in bytes(r.block).decode() and f"source-length: {len(bodies[int(i)][1])}" in bytes(r.block).decode()


def test_warc_odd_input(spark):
    assert warc.plain_text("<p>a <a title='x>y' href=\"q>z\">hi</a> b<p>don't <b class=it's>stop</b> it's") == "a hi b\ndon't stop it's"
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nSet-Cookie: b\r\nX-Empty:\r\n\r\nbody"
    archive = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:1>\r\nX-None:\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    record = next(warc.parse(archive))
    assert record["block"] == block and record["fields"]["X-None"] == ""
    assert warc._fields(block.partition(b"\r\n\r\n")[0]) == {"Set-Cookie": "a, b", "X-Empty": ""}
    long = "<p>" + "word " * 200_000
    rows = [(1, "u", long), (1, "u", long), (2, "u", ""), (None, None, None)]
    pages = spark.createDataFrame([(*r, "k", "h") for r in rows], "page_id long, url string, html string, key string, headers string")
    got = warc.derivatives(warc.responses_of(pages)).collect()
    assert len(got) == 8 and sum(bytes(r.block) == ("word " * 200_000).strip().encode() for r in got) == 2
    assert {r.content_length for r in got if r.record_type == "conversion"} == {len(("word " * 200_000).strip()), 0}


def test_line_dedup_against_brute_force(spark):
    r = random.Random(9)
    lines = [f"{r.choice(['  ', ''])}Some line number {k} of the text{r.choice(['', ' ', chr(9)])}" for k in range(40)] + ["short", "", "É" * 20, "e" * 19 + "É"]
    rows = [(i, r.choice([None, ""]) if i % 17 == 0 else "\n".join(r.choices(lines, k=r.choice((1, 3, 12)))), "en") for i in range(120)] + [(200, "x " * 100_000 + "\n" + lines[0], "en")]
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    gone = {k: max(ids) for k, ids in held.items() if len(k) >= 20 and len(ids) >= 3}
    df = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, lang string, n_lines int")
    got = {x.doc_id: x for x in linededup.dedup_lines(df).collect()}
    assert len(got) == len(rows) and sum(x.n_dropped > 0 for x in got.values()) > 50
    for i, t, _ in rows:
        whole = (t or "").split("\n")
        kept = [x for x in whole if key(x) not in gone or gone[key(x)] == i]
        assert (got[i].text or "", got[i].n_lines, got[i].n_dropped) == ("\n".join(kept), len(whole), len(whole) - len(kept))


def test_language_scores_against_plain_python(spark):
    """The scores of whole texts by the definition: words first, else the longest known n-grams."""
    r = random.Random(6)
    words = {lang: ["".join(r.choices(letters, k=r.randint(1, 7))) for _ in range(60)] for lang, letters in (("aa", "abcdé"), ("bb", "cdefg"), ("cc", "fghæi"))}
    rows = [(i, " ".join(r.choices(words[lang], k=30)), lang) for i, lang in enumerate(r.choices(list(words), k=90))]
    rows += [(500, "Abæd zzzz q 7 " * 30_000, None), (501, "", None), (502, rows[0][1], None), (502, rows[0][1], None)]
    seen = [(t, lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    langs = sorted({lang for _, lang in seen})
    tables = {n: {} for n in (0, 5, 4, 3, 2, 1)}
    for t, lang in seen:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            for n in tables:
                for g in [w] if n == 0 else langid._grams_of(w, n):
                    tables[n].setdefault(g, dict.fromkeys(langs, 0))[lang] += 1
    logs = {}
    for n, own in tables.items():
        total = {x: sum(c[x] for c in own.values()) for x in langs}
        logs[n] = {}
        for g, c in own.items():
            v = np.array([np.log(c[x] + 0.5) - np.log(total[x] + 0.5 * len(own)) for x in langs])
            logs[n][g] = v - v.mean()

    def score(word):
        if word in logs[0]:
            return logs[0][word]
        for n in (5, 4, 3, 2, 1):
            found = [logs[n][g] for g in langid._grams_of(word, n) if g in logs[n]]
            if found:
                return sum(found) / n
        return np.zeros(len(langs))

    df = spark.createDataFrame([(*x, True, "x", 1) for x in rows], "doc_id long, text string, lang string, held_out boolean, lang_pred string, score int")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    for x in got:
        if not x.text:
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        total = sum(score(w) for w in re.findall(r"[^\W\d_]+", x.text.lower()))
        odds = np.exp(total - total.max())
        assert x.lang_pred == langs[int(odds.argmax())] and x.score == pytest.approx(float(odds.max() / odds.sum()), abs=1e-3)


def test_url_filter_with_redirects_equals_its_sql(spark, tmp_path):
    import duckdb

    from meshvoyage.llm.queries import ORACLES

    r = random.Random(12)
    urls = [f"https://h{i}.example.{r.choice(['org', 'com', 'net'])}/{r.choice(['es', 'en', 'de', 'fr'])}/{i}" for i in range(60)]
    pages = [(i, u, f'<link rel="canonical" href="{r.choice(urls)}">' if r.random() < 0.4 else r.choice([None, ""])) for i, u in enumerate(urls)]
    pages += [(100, urls[0], None), (101, urls[0] + "#part", f'<link rel="canonical" href="{urls[1]}">')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.coalesce(1).write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    expected = sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLES['op7_url_filter']})").fetchall())
    got = sorted(tuple(x) for x in urlfilter.judge(df, RULES).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == expected and {x[3] is None and x[4] for x in got} == {False, "allow", "block"}


def test_html_text_on_pages_written_by_hand(spark):
    """Layouts that no training page has; blocks of main text, 16 of 18 found, and 16 of 18 given are right."""
    from hand_pages import PAGES

    df = spark.createDataFrame([(i, f"u{i}", html, 1) for i, (html, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0], 1)], "page_id int, url string, html string, n_chars int")
    got = htmltext.extract(df).collect()
    assert len(got) == len(PAGES) + 1 and len({x.text for x in got if x.page_id == 0}) == 1
    texts = {x.page_id: x.text.split("\n\n") for x in got}
    right = sum(len(set(texts[i]) & set(blocks)) for i, (_, blocks) in enumerate(PAGES))
    assert right >= 0.85 * sum(len(blocks) for _, blocks in PAGES) and right >= 0.85 * sum(map(len, texts.values()))
