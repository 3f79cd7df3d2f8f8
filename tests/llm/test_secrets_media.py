"""Secret scans and media sequences against plain Python and exact round trips."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from archivelake.llm import media, queries, secret_scan

SECRET = "password = hunter2hunter2"
KEY = "AKIA" + "ABCDEFGH12345678"


def brute_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, b, k in sorted(out)]


PARTS = ["password", "Token", "secret", "api_key", "APIKEY", "=", ": ", '"', "abcdefgh1", "AKIA", "ABCDEF123456", "0123456789abcdef", " ", "é", "ſecret", "to\u212aen", "%3D", "\\u0041", "\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
def test_base_spans(text):
    base, spans = secret_scan.all_spans(text)
    assert base == brute_base(text) and set(base) <= set(spans)
    if spans:
        assert secret_scan.suspects(pa.array(["x", text]))[1]


def kinds(text):
    return [s[0] for s in secret_scan.all_spans(text)[1]]


def test_layers():
    b64 = base64.b64encode(SECRET.encode()).decode()
    assert kinds(f"see {b64} end") == ["b64/assign"]
    assert secret_scan.all_spans(f"see {b64} end")[1] == [("b64/assign", 4, 4 + len(b64))]
    assert kinds(quote(SECRET, safe="")) == ["url/assign"]
    assert kinds(quote(quote(SECRET, safe=""), safe="")) == ["url/url/assign"]
    assert kinds("".join(f"\\u{ord(c):04x}" for c in SECRET)) == ["esc/assign"]
    assert kinds("".join(f"&#{ord(c)};" for c in KEY)) == ["esc/access"]
    packed = base64.b64encode(gzip.compress(zlib.compress(SECRET.encode()))).decode()
    assert kinds(packed) == ["b64/zip/zip/assign"]
    nested = base64.b64encode(quote(f"x {b64} y").encode()).decode()
    assert kinds(f"é {quote(nested)} ") == ["b64/url/b64/assign"] or "assign" in kinds(f"é {quote(nested)} ")[0]
    for text in (packed, nested, b64, quote(SECRET, safe="")):
        assert secret_scan.suspects(pa.array([text])).all()


def test_positions_inside_percent_layers():
    text = "né see a=1&pass%77ord=hunter2hunter2&b rest"
    _, spans = secret_scan.all_spans(text)
    assert spans == [("url/assign", text.index("pass"), text.index("&b"))]


def test_bomb_and_cycles(monkeypatch):
    monkeypatch.setattr(secret_scan, "MOST_LAYER", 1 << 20)
    bomb = base64.b64encode(gzip.compress(b"\0" * (secret_scan.MOST_LAYER + 10))).decode()
    assert kinds(bomb) == ["bomb"]
    assert kinds("aaaaaaaaaaaaaaaaaaaaaaaa " * 50) == []


def wrapped(data, width, end="\n"):
    text = base64.b64encode(data).decode()
    return end.join(text[i : i + width] for i in range(0, len(text), width))


def test_compressed_bytes_in_escapes():
    for data in (gzip.compress(SECRET.encode(), mtime=0), zlib.compress(SECRET.encode())):
        forms = [quote(data, safe=""), "".join(f"%{b:02x}" for b in data), "".join(f"\\x{b:02x}" for b in data), repr(data), "".join(f"&#{b};" for b in data)]
        for form in forms:
            text = f"né data={form} rest of it"
            assert kinds(text) == [("url" if form[0] in "x%" and "%" in form else "esc") + "/zip/assign"], form
            a, b = secret_scan.all_spans(text)[1][0][1:]
            assert a <= 8 + (form[0] == "b") * 2 and b >= text.index(" rest") - 4
            assert secret_scan.suspects(pa.array([text])).all()


def test_base64_over_lines():
    long = b"nothing to see here, " * 7 + SECRET.encode() + b" and more of the same, on and on" * 3
    for width, end in ((64, "\n"), (76, "\r\n"), (8, "\n  ")):
        for data, kind in ((long, "b64/assign"), (gzip.compress(long + bytes(range(256)), mtime=0), "b64/zip/assign")):
            text = f"begin:\n\n{wrapped(data, width, end)}\n\nend."
            assert kinds(text) == [kind] and secret_scan.suspects(pa.array(["", text]))[1]
            _, a, b = secret_scan.all_spans(text)[1][0]
            assert 0 < a < b < len(text)
            if kind == "b64/assign":  # the lines that hold it, no others
                assert b - a <= 3 * (width + len(end)) + 40
                assert SECRET.encode() not in base64.b64decode((text[8:a] + text[b:-6]).replace("=", "") + "==" * 2)


def test_base64_glued_and_bytes_that_are_not_text():
    raw = b"\xff\xfe\x80 " + SECRET.encode() + b" \xff"
    packed = gzip.compress(SECRET.encode(), mtime=0)
    for front in ("", "/", "com/path/", "ab", "word", "x-y_z"):
        for data in (SECRET.encode(), raw, packed):
            text = f"see {front}{base64.b64encode(data).decode()} end"
            assert kinds(text) == ["b64/zip/assign" if data is packed else "b64/assign"], text
            assert secret_scan.suspects(pa.array([text])).all()
    assert kinds("a plain text with internationalisation\nand uncharacteristically-long words/paths/of/all/kinds") == []


@pytest.mark.parametrize("compress", [gzip.compress, bz2.compress, lzma.compress, zstandard.compress, zlib.compress])
def test_all_members_and_all_of_a_large_layer(monkeypatch, compress):
    monkeypatch.setattr(secret_scan, "MOST_LAYER", 1 << 17)
    monkeypatch.setattr(secret_scan, "OVERLAP", 1 << 10)
    code = lambda data: base64.b64encode(data).decode()
    raw = SECRET.encode()
    assert kinds(code(compress(b"first, " * 9) + compress(raw))) == ["b64/zip/assign"]
    assert kinds(code(compress(compress(raw)))) == ["b64/zip/zip/assign"]
    for front in (0, 1 << 17, (1 << 17) + 1 - len(raw) // 2, 400_000):
        text = f"see {code(compress(b' ' * front + raw + b' ' * 200_000))} end"
        assert kinds(text) == ["b64/zip/assign", "bomb"] and {s[1:] for s in secret_scan.all_spans(text)[1]} == {(4, len(text) - 4)}
    assert kinds(code(compress(b" " * 300_000 + code(raw).encode()))) == ["b64/zip/b64/assign", "bomb"]
    assert kinds(code(compress(raw + b" " * 300)[:-3])) in ([], ["b64/zip/assign"])  # damaged


def test_surrogate_pairs_and_stray_signs():
    assert secret_scan._escape("\\ud83d\\ude00") == "😀"
    assert kinds("100% of \\ud83d\\ude00\\u0070assword=hunter2hunter2 & 5%") == ["esc/assign"]


def test_time_grows_with_the_findings_and_not_with_their_square():
    one = base64.b64encode(b"token=abcdefgh").decode()
    assert kinds(f"{one} " * 5000) == ["b64/assign"] * 5000
    assert kinds("%" * 50_000 + "x" * 50_000) == []


def decoded(text, depth=0):
    """Secrets in a text and in what its percent and base64 segments decode to, by plain recursion."""
    out = {m for _, a, b in brute_base(text) for m in [text[a:b]]}
    if depth < 6:
        for m in re.finditer(r"\S*%[0-9A-Fa-f]{2}\S*", text):
            out |= decoded(unquote(m[0]), depth + 1)
        for m in re.finditer(r"[A-Za-z0-9+/]{16,}={0,2}", text):
            run = m[0].rstrip("=")
            run = run[: len(run) - (len(run) % 4 == 1)]
            data = base64.b64decode(run + "=" * (-len(run) % 4))
            if data[:2] == b"\x1f\x8b":
                data = gzip.decompress(data)
            out |= decoded(data.decode("latin-1"), depth + 1)
    return out


def test_random_nestings_against_plain_recursion():
    rng = random.Random(6)
    wraps = [lambda t: quote(t, safe=""), lambda t: base64.b64encode(t.encode()).decode(), lambda t: base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode()]
    for _ in range(120):
        text = rng.choice([SECRET, KEY, "nothing to be seen", "0123456789abcdef" * 2])
        for _ in range(rng.randrange(4)):
            text = f"{'go on ' * rng.randrange(4)}{rng.choice(wraps)(text)}{' and so on' * rng.randrange(3)}"
        found = decoded(text)
        assert bool(found) == bool(kinds(text)), text
        assert {k for k, _, _ in brute_base(text)} <= set(kinds(text))


def test_scan_query(spark, sf_dir, texts):
    rows = queries.op7_secret_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_base(texts[r.doc_id] or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in base) for x in secret_scan.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert r.spans == secret_scan.joined(secret_scan.all_spans(texts[r.doc_id] or "")[1])


def test_redact(make_docs):
    docs = make_docs([f"é {SECRET} and {KEY}!", None, "", "clean", (None, SECRET), (7, "x " * 90000)], extra=True)
    got = secret_scan.redact(docs)
    assert got.columns == docs.columns
    assert [r.text for r in got.collect()] == ["é [SECRET] and [SECRET]!", None, "", "clean", "[SECRET]", "x " * 90000]
    assert secret_scan.scan(make_docs([])).count() == 0 == secret_scan.redact(make_docs([])).count()


def test_media_query(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in queries.op6_media_sequences(spark, sf_dir).collect()}
    assert rows.keys() == texts.keys()
    for k, text in texts.items():
        raw = (text or "").encode()
        payload = media.pad(raw)
        stored = media.png(payload)
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), plain_feature(payload))
        paragraphs = [bool(x.split()) for x in (text or "").split("\n")]
        assert (r.position, r.n_elements) == (int(paragraphs[0]), sum(paragraphs) + 1)


def plain_feature(payload):
    """The feature of a payload, sample by sample."""
    rows = [payload[i : i + 192] for i in range(0, len(payload), 192)]
    n, total, square = len(payload), sum(payload), sum(x * x for x in payload)
    bits = ""
    for i in range(8):
        a, b = len(rows) * i // 8, len(rows) * (i + 1) // 8
        a, b = min(a, len(rows) - 1), min(max(b, a + 1), len(rows))
        for j in range(0, 192, 24):
            cell = sum(sum(r[j : j + 24]) for r in rows[a:b])
            bits += str(int(cell * n > total * (b - a) * 24))
    return f"192x{len(rows)};mean={1000 * total // n};square={1000 * square // n};grid={int(bits, 2):016x}"


def test_media_of_odd_documents(spark, make_docs, tmp_path):
    """Signs of HTML in texts and captions, nulls, repeated and null keys, a very long text."""
    schema = "doc_id long, text string, source string, digest string"
    rows = [(1, "a <b> & \"c\"\n\nsecond &amp; line\nthird", 'a<img src="x">b', "d"), (2, None, None, "d"), (2, "", "s", "d"), (None, "\n<figure>\n", "&lt;", "d"), (5, "long " * 400_000, "t", "d"), (6, "a <b> & \"c\"", "u", "d")]
    for part in (rows, []):
        spark.createDataFrame(part, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = {(r.doc_id, r.n_bytes): (r.position, r.n_elements, r.caption) for r in queries.op6_media_sequences(spark, str(tmp_path)).collect()}
        want = {(1, 36): (1, 4, 'a<img src="x">b'), (2, 0): (0, 1, "s"), (None, 10): (0, 2, "&lt;"), (5, 2_000_000): (1, 2, "t"), (6, 11): (1, 2, "u")}
        if part:
            caption = got[2, 0][2]
            assert caption in ("", "s") and got | {(2, 0): (0, 1, "s")} == {(k, len((t or "").encode())): want[k, len((t or "").encode())] for k, t, _, _ in rows}
        else:
            assert got == {}


def test_order_of_elements_around_references(spark):
    html = "<html><head><title>t</title><body>one<img src='sha256:aa'>two<figure><img src='sha256:bb'><figcaption>open</figure>three"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    media_rows = spark.createDataFrame([("aa", 1)], "digest string, size int")
    got = media.resolve(media.sequences(pages, "page_id", "html"), "page_id", media_rows).orderBy("position").collect()
    assert [(r.position, r.digest, r.caption, r.n_elements, r.before, r.after, r.size) for r in got] == [(1, "aa", None, 5, "one", "two", 1), (3, "bb", "open", 5, "two", "three", None)]


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=2000))
def test_png_round_trip(data):
    payload = media.pad(data)
    assert len(payload) % 192 == 0 < len(payload) and media.samples(media.png(payload)).tobytes() == payload


def test_interleaving_keeps_order_positions_and_captions(spark):
    html = """<head><title>no</title></head><p>one <b>two</b></p><figure><img src="sha256:aa" alt="alt"><img src="sha256:bb">
    <figcaption>cap <i>tion</i></figcaption></figure>three<img src='sha256:zz' alt="last"/><script>var x = "<p>";</script>four &amp; five"""
    assert [(e["position"], e["kind"], e["text"] or e["media"], e["caption"]) for e in media.parse(html)] == [
        (0, "text", "one two", None), (1, "img", "sha256:aa", "cap tion"), (2, "img", "sha256:bb", "cap tion"),
        (3, "text", "three", None), (4, "img", "sha256:zz", "last"), (5, "text", "four & five", None),
    ]
    pages = spark.createDataFrame([(1, html, "x"), (2, None, "x"), (3, "", "x"), (None, html, "x")], "page_id long, html string, elements string")
    sequence = media.sequences(pages, "page_id", "html")
    assert {r.page_id: len(r.elements) for r in sequence.collect()} == {1: 6, 2: 0, 3: 0, None: 6}
    payloads = spark.createDataFrame([("aa", 1), ("zz", 2)], "digest string, size int")
    got = media.resolve(sequence, "page_id", payloads).where("page_id = 1").orderBy("position").collect()
    assert [(r.position, r.digest, r.caption, r.size) for r in got] == [(1, "aa", "cap tion", 1), (2, "bb", "cap tion", None), (4, "zz", "last", 2)]


def test_pages_parse(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = media.sequences(pages, "page_id", "html").collect()
    assert len(rows) == pages.count() and all([e.position for e in r.elements] == list(range(len(r.elements))) for r in rows)
