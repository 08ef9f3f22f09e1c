"""Each operator against a plain version, and on nulls, ties, repeats, empty tables and clashing names."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import bpe, fair_mix, guess_cost, host_reputation, importance, isolation, near_copies, queries, simhash_pivot, transport_stream, tree_extract, warc_zip

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, ties, repeated rows, a long text, and extra columns with names that operators use themselves."""
    long = " ".join(f"word{i} password=abcdef{i}" for i in range(6000))
    rows = [
        (1, "a b c d e f", "en", "s1", 11), (1, "a b c d e f", "en", "s1", 11), (2, "A b c D e f", "en", "s1", 11), (3, None, None, None, None), (4, "", "en", None, 0), (None, "x y", "en", "s2", 3),
        (None, None, None, None, None), (5, long, "en", "s2", len(long)), (6, " \t\n ", "en", "s3", 4), (7, "é́ 中文 💥 token: \"secretvalue1\"", "zh", "s3", 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(1) for c in ("key", "fp", "size", "h", "taken", "kept", "n_words", "root", "h2")})


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# ---- 1


def plain_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    for kind, (name, pattern, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        out += [(m.start(), kind, m.end(), name) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [f"{n}:{a}:{b}" for a, _, b, n in sorted(out)]


def test_secrets_equal_plain_patterns(docs, odd):
    for df in (docs, odd):
        got = collections.Counter((r.doc_id, r.base_sha256, r.n_assign + r.n_access + r.n_hex) for r in guess_cost.scan(df).collect())
        plain = [(i, plain_spans(t)) for i, t in texts_of(df)]
        assert got == collections.Counter((i, hashlib.sha256(",".join(s).encode()).hexdigest(), len(s)) for i, s in plain)


def plain_piece(value, words):
    """Decades of guesses of a whole string as one piece, or None where it must be brute force: written from the rules, not from the operator."""
    n, low, leet = len(value), value.lower(), value.lower().translate(str.maketrans("013457@$!", "oleastasi"))
    out = []
    case = 0.0 if value == low else 0.3 if value.istitle() or value.isupper() else 1.0
    if n >= 3 and low in words:
        out.append(words[low] + case)
    elif n >= 3 and leet in words:
        out.append(words[leet] + case + 0.5)
    if re.fullmatch(r"(19|20)\d\d", value):
        out.append(2.1)
    if re.fullmatch(r"(19|20)\d\d[-/._]?(0[1-9]|1[0-2])[-/._]?(0[1-9]|[12]\d|3[01])|(0[1-9]|[12]\d|3[01])[-/._]?(0[1-9]|1[0-2])[-/._]?(19|20)\d\d", value):
        out.append(4.7)
    char = lambda c: 1.0 if c.isdigit() else 1.415 if c.isalpha() and c.isascii() else 1.519 if c.isascii() else 3.0
    for period in range(1, 5):
        if n - period >= max(2, period) and all(value[i] == value[i + period] for i in range(n - period)):
            out.append(sum(map(char, value[:period])) + np.log10(n / period))
    for row in ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz"):
        if n >= 3 and (low in row or low[::-1] in row):
            out.append(1.7 + np.log10(n))
    return min(out) if out else None


def brute_cost(value):
    """The cheapest cut of a short value by trying all."""
    words = {w: np.log10(rank + 1) for rank, w in enumerate(guess_cost.COMMON, 1)}
    char = lambda c: 1.0 if c.isdigit() else 1.415 if c.isalpha() and c.isascii() else 1.519 if c.isascii() else 3.0
    best = [0.0]
    for j in range(1, len(value) + 1):
        pieces = [(best[i] + cost + 0.3) for i in range(j) if (cost := plain_piece(value[i:j], words)) is not None]
        best.append(min([best[-1] + char(value[j - 1]), *pieces]))
    return best[-1]


def test_guess_cost_is_the_cheapest_segmentation():
    chance = random.Random(3)
    for _ in range(60):
        value = "".join(chance.choice(["a", "q", "w", "1", "2", "pass", "love", "2024", "zz"]) for _ in range(5))[:12]
        assert guess_cost.guess_cost(value) == pytest.approx(brute_cost(value))
    weak = ("password123", "qwertyuiop", "aaaaaaaaaaaa", "20240131", "iloveyou2")
    assert all(guess_cost.guess_cost(v) < guess_cost.LIMIT for v in weak)
    assert all(guess_cost.guess_cost(v) >= guess_cost.LIMIT for v in ("xK9$vQ2#mLp8", "b8afebf33dd8eac10b"))


def test_method_adds_spans_and_keeps_base_ones():
    found = guess_cost.spans("pwd: xK9$vQ2#mLp8zz, passphrase is qwertyuiop and token=abcdef12")
    assert [k for k, _, _ in found] == ["guess", "assign"]
    assert guess_cost.spans("db://user:xK9$vQ2mLp8zz@host/x")[0][0] == "guess"


def test_contexts_have_no_caps_and_no_pieces_of_words():
    kinds = lambda text: [k for k, _, _ in guess_cost.spans(text)]
    for gap in (0, 1, 7, 9, 300):
        assert kinds("pwd:" + " " * gap + "xK9$vQ2#mLp8") == ["guess"]
        assert kinds("pwd" + " " * gap + "= xK9$vQ2#mLp8") == ["guess"]
    prose = ("The secret is definitely out.", "The token is immutable", "bypass is significantly longer", "The SECRET IS SIGNIFICANTLY older", "his secret is self-explanatory", "compass: xK9$vQ2#mLp8", "BYPASS: xK9$vQ2#mLp8")
    assert [t for t in prose if kinds(t)] == []
    assert kinds("the password is xK9$vQ2#mLp8") == kinds("dbPassword -> xK9$vQ2#mLp8") == kinds("db_pass: xK9$vQ2#mLp8") == ["guess"]


def test_urls_stamps_types_and_names_are_no_secrets():
    kinds = lambda text: [k for k, _, _ in guess_cost.spans(text)]
    plain = (
        "login: 2024-01-02T10:00:00Z", "login: 20240102T100000+01:00", "token: https://example.com/docs/getting-started", "authorization: application/json", "authorization: text/html;charset=utf-8", "the token is user_name_field",
        "Bearer: M\u00fcnchengladbach", "login = example.com/account/settings", "the secret is self-explanatory", "login: /usr/share/documents/readme",
    )
    assert [t for t in plain if "guess" in kinds(t)] == []
    secret = (
        "login: https://hooks.example.com/services/T0A9ZK3/xK9vQ2mLp8zzQw41", "passphrase: xK9$vQ2#mLp8", "pwd: 2024-01-02T10:00:00Zq9#Lx7Vw", "bearer: application/xK9$vQ2#mLp8", "login = kq7ZzP0w_Lm3", "db://user:xK9$vQ2mLp8zz@host/x", "the passcode is kq7ZzP0w_Lm3",
    )
    assert [t for t in secret if kinds(t) != ["guess"]] == []


def test_planted_secrets_and_planted_prose():
    """Recall and false positives over values of each kind, with the fixed words alone."""
    chance = random.Random(11)
    letters, every = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = lambda n: [w for w in chance.choices(guess_cost.COMMON, k=n)]
    secrets = ["".join(chance.choice(every + "#$%^*") for _ in range(chance.randint(12, 24))) for _ in range(300)]
    harmless = [f"20{chance.randint(10, 30)}-0{chance.randint(1, 9)}-1{chance.randint(0, 9)}T0{chance.randint(0, 9)}:15:30Z" for _ in range(100)]
    harmless += [f"https://{chance.choice(words(1))}.com/" + "/".join("".join(chance.choice(letters) for _ in range(chance.randint(3, 14))) for _ in range(3)) for _ in range(100)]
    harmless += ["image/" + "".join(chance.choice(letters) for _ in range(6)) for _ in range(100)]
    hits = lambda values: sum("guess" in [k for k, _, _ in guess_cost.spans(f"passphrase: {v} and so on")] for v in values)
    assert hits(secrets) >= 0.99 * len(secrets) and hits(harmless) == 0


def test_many_contexts_in_one_text_take_linear_time():
    import time

    started = time.time()
    text = " ".join(f"token=abcdef{i} pwd: abcdef12" for i in range(30_000))
    assert len(guess_cost.spans(text)) == 30_000 and time.time() - started < 30


def test_redaction_takes_every_span(spark):
    df = spark.createDataFrame([(1, "a password=abcdef1 b", "en", "s", 1), (2, None, "en", "s", 1)], DOCS)
    assert [r.text for r in guess_cost.redact(df).orderBy("doc_id").collect()] == ["a [secret] b", None]


def test_ordinary_words_are_no_secrets(spark):
    prose = ("patience available constitution state-of-the-art", "Geduld Verfassung Umgebungsvariable", "constitución disponible", "patience étranger бесконечность")
    rows = [(i, prose[i % 4] + f" item{i} qzkvwxjprt" * (i == 0), "xx", "s", 1) for i in range(8)]
    said = ["the secret is patience.", "login: available", "login -> Constitution", "bearer: state-of-the-art", "login: Umgebungsvariable", "login: disponible", "login: étranger", "login: бесконечность", "login: 请在登录页面，输入您的密码。"]
    random_ = ["the secret is xK9$vQ2#mLp8", "login: qzkvwxjprt", "login: hTqPzVwRkc", "pwd: b8afebf33dd8eac10b"]
    rows += [(100 + i, t, "xx", "s", 1) for i, t in enumerate(said + random_ + random_)]
    df = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id: r.n_guess for r in guess_cost.scan(df).collect()}
    assert [t for i, t in enumerate(said) if found[100 + i]] == []
    assert all(found[100 + len(said) + i] == 1 for i in range(2 * len(random_)))
    kept = {r.doc_id: r.text for r in guess_cost.redact(df).collect()}
    assert all(kept[100 + i] == t for i, t in enumerate(said))


def test_vocabulary_is_bounded_and_ranked(spark):
    df = spark.createDataFrame([(i, " ".join(["often"] + ["seldom"] * (i < 3) + ["zeta", "theta", "kappa", "sigma"] * (i < 2) + ["once"] * (i == 0)), "en", "s", 1) for i in range(5)], DOCS)
    whole = set(guess_cost.vocabulary(df)) - set(guess_cost.WORD_COST)
    assert whole == {"often", "seldom", "zeta", "theta", "kappa", "sigma"}
    words = guess_cost.vocabulary(df, 4)
    assert {"often", "seldom"} <= set(words) - set(guess_cost.WORD_COST) <= whole and len(set(words) - set(guess_cost.WORD_COST)) <= 4
    assert words["often"] < words["seldom"]


# ---- 2


def test_archives_round_trip(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").limit(40)
    more = spark.createDataFrame([(1001, "http://x/\r\ny", "same"), (1002, None, "same"), (1003, "u", None), (None, "u", None), (None, "u", "alone"), (1004, "u", ""), (1002, None, "same")], "page_id bigint, url string, html string")
    rows = pages.select("page_id", "url", "html").unionByName(more).collect()
    got = warc_zip.archive_round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("x"))).collect()
    largest = {}
    for r in rows:
        if r.page_id is not None:
            largest[r.html or ""] = max(largest.get(r.html or "", r.page_id), r.page_id)
    expected = collections.Counter()
    for r in rows:
        raw, top = (r.html or "").encode(), largest.get(r.html or "")
        kind = "response" if r.page_id == top else "revisit"
        expected[(r.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, top if kind == "revisit" else None)] += 1
    assert collections.Counter(map(tuple, got)) == expected


def test_ids_of_text_and_very_long_pages(spark):
    rows = [("a>b: \u00e9", "u", "same"), ("", "u", "same"), ("z\n", "u", "x" * (9 << 20)), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").withColumns({"key": F.lit(1), "bytes": F.lit(2), "response_id": F.lit(3)})
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc_zip.archive_round_trip(df).collect()}
    assert got == {"a>b: \u00e9": (4, "response", None), "": (4, "revisit", "a>b: \u00e9"), "z\n": (9 << 20, "response", None), None: (0, "response", None)}


def test_bytes_of_every_value_pass_the_text_writer(spark, tmp_path):
    pieces = [bytes([i]) + bytes(range(256)) + bytes([255 - i]) for i in range(256)]
    df = spark.createDataFrame([(p,) for p in pieces], "piece binary").coalesce(1)
    df.select(F.col("piece").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{tmp_path}/out")
    assert b"".join(p.read_bytes() for p in (tmp_path / "out").glob("*.txt")) == b"".join(p + b"\n" for p in pieces)


def test_archives_are_many_and_each_has_an_index(spark, tmp_path, monkeypatch):
    import zipfile

    monkeypatch.setattr(warc_zip, "ARCHIVE", 1 << 16)
    monkeypatch.setattr(warc_zip, "MEMBER", 1 << 14)
    pages = spark.createDataFrame([(i, "u", random.Random(i).randbytes(4000).hex()) for i in range(60)], "page_id bigint, url string, html string")
    warc_zip.write_archives(warc_zip.with_roles(pages), f"{tmp_path}/zips")
    files = sorted((tmp_path / "zips").glob("*.txt"))
    assert len(files) >= 7
    for f in files:
        with zipfile.ZipFile(f) as z:
            assert z.testzip() is None and "indexes/index.cdxj" in z.namelist() and max(i.file_size for i in z.infolist()) < 1 << 16


def test_archive_reader_takes_both_forms_of_directory(tmp_path):
    import zipfile

    path = tmp_path / "plain.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as out:
        out.writestr("archive/a.warc.gz", b"0123456789")
        out.writestr("indexes/index.cdxj", '{"urn": 1, "filename": "archive/a.warc.gz", "offset": 3, "length": 4}')
        out.comment = b"PK in a comment"
    raw = path.read_bytes()
    assert [raw[a : a + n] for a, n in warc_zip.ranges(len(raw), lambda at, n: raw[at : at + n])] == [b"3456"]
    made = warc_zip.ZipWriter()
    raw = made.member("archive/a.warc.gz", b"0123456789") + b"\n" + made.member("indexes/i", b'{"filename": "archive/a.warc.gz", "offset": 1, "length": 2}') + b"\n" + made.end() + b"\n"
    assert [raw[a : a + n] for a, n in warc_zip.ranges(len(raw), lambda at, n: raw[at : at + n])] == [b"12"]
    (tmp_path / "own.zip").write_bytes(raw)
    with zipfile.ZipFile(tmp_path / "own.zip") as read:
        assert read.testzip() is None and read.read("archive/a.warc.gz") == b"0123456789"
    with pytest.raises(ValueError):
        warc_zip.directory(30, lambda at, n: b"\0" * n)


# ---- 3


def test_rules_and_hosts(spark):
    urls = ["https://WWW.Example.com/en/7x", "http://a.com/en/1?x", "http://example.net/de/81", "http://net/de/", "http://x.org/es/#a", "nothing", None, "http://notexample.com", "://", "http://h/a?b://c"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    labels = spark.createDataFrame([(7, 1, 0), (None, 0, 0), (1, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in host_reputation.judge(pages, labels, queries.URL_RULES).collect()}
    assert got[0] == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1] == ("a.com", "/en/1", "com/en/", "block")
    assert got[2] == ("example.net", "/de/81", "example.net/de/8", "block")
    assert got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("org/es/", "block")
    assert got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None) and got[7][2] is None
    assert got[9][:2] == ("h", "/a")


def test_bad_hosts_are_blocked_and_others_pull_few_labels_up(spark):
    rows = [(i, f"http://bad.example.com/xx/{i}") for i in range(60)] + [(i, f"http://good.example.com/xx/{i}") for i in range(60, 160)] + [(160, "http://new.example.com/xx/160"), (161, "http://new.example.com/xx/161")]
    labels = spark.createDataFrame([(i, 0 if i < 57 else 1, 0) for i in range(160)], "doc_id bigint, quality int, toxic int")
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    got = {(r.host, r.verdict) for r in host_reputation.judge(pages, labels, []).collect()}
    assert got == {("bad.example.com", "block"), ("good.example.com", "allow"), ("new.example.com", "allow")}


def test_registered_domains(spark):
    want = {
        "www.a.co.uk": ("co.uk", "a.co.uk"), "x.y.org.uk": ("org.uk", "y.org.uk"), "a.com.br": ("com.br", "a.com.br"), "b.a.co.kr": ("co.kr", "a.co.kr"), "me.github.io": ("github.io", "me.github.io"),
        "user@a.example.com:8080": ("com", "example.com"), "10.0.0.1:80": ("ip", "10.0.0.1"), "[::1]:80": ("ip", "[::1]"), "example.com.": ("com", "example.com"), "co.uk": ("co.uk", "co.uk"), "": ("", ""), "localhost": ("localhost", "localhost"),
    }
    df = spark.createDataFrame([(h,) for h in want], "host string").withColumn("name", host_reputation.name_of(F.col("host"))).withColumn("suffix", host_reputation.suffix_of(F.col("name")))
    assert {r.host: (r.suffix, r.domain) for r in df.withColumn("domain", host_reputation.domain_of(F.col("name"), F.col("suffix"))).collect()} == want


def test_documents_are_whole_numbers(spark):
    """Numbers of any length count whole, and what only begins with a number is none."""
    urls = ["http://a.com/x/7", "http://b.com/x/7abc", "http://c.com/x/0007/", "http://d.com/x/1234567890123456789012", "http://e.com/x/123456789012345678"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    named = pages.select(host_reputation.host_of(F.col("url")).alias("host"), host_reputation.path_of(F.col("url")).alias("path"))
    for kind, ids in (("bigint", [7, 123456789012345678]), ("string", ["7", "1234567890123456789012"])):
        labels = spark.createDataFrame([(i, 0, 0) for i in ids], f"doc_id {kind}, quality int, toxic int")
        got = {r.host for r in host_reputation.outcomes_of(named, labels, r"^/[^/]+/([0-9]+)(?:/|$)").collect()}
        assert got == {"a.com", "c.com", "e.com" if kind == "bigint" else "d.com"}


def test_strangers_under_one_suffix_do_not_answer_for_each_other(spark):
    rows = [(i, f"http://bad.com.br/x/{i}") for i in range(60)] + [(i, f"http://s{i % 8}.com.br/x/{i}") for i in range(60, 220)] + [(999, "http://new.com.br/x/999")]
    labels = spark.createDataFrame([(i, 0 if i < 58 else 1, 0) for i in range(220)], "doc_id bigint, quality int, toxic int")
    got = {(r.host, r.verdict) for r in host_reputation.judge(spark.createDataFrame(rows, "page_id bigint, url string"), labels, []).collect()}
    assert ("bad.com.br", "block") in got and all(v == "allow" for h, v in got if h != "bad.com.br")


def test_posteriors_equal_plain_shrinkage(spark):
    rows = [("a.x.com", "x.com", "com", 10, 8), ("b.x.com", "x.com", "com", 5, 0), ("y.com", "y.com", "com", 0, 0), ("z.org", "z.org", "org", 20, 3)]
    got = {r.host: (r["mean"], r.sd) for r in host_reputation.posteriors(spark.createDataFrame(rows, "host string, domain string, suffix string, n bigint, k bigint")).collect()}

    def level(groups, mu):
        known = [(n, k, mu[key]) for key, (n, k) in groups.items() if n]
        spread = [m * (1 - m) for _, _, m in known]
        down = sum((n - 1) * s for (n, _, _), s in zip(known, spread))
        rho = (sum(n * (k / n - m) ** 2 for n, k, m in known) - sum(spread)) / down
        return 1 / min(max(rho, 1e-4), 0.999) - 1

    suffix, domain = {"com": (15, 8), "org": (20, 3)}, {"x.com": (15, 8), "y.com": (0, 0), "z.org": (20, 3)}
    top = (11 + 0.5) / (35 + 1)
    mu = dict.fromkeys(suffix, top)
    m = level(suffix, mu)
    post = {s: (mu[s] * m + k) / (n + m) for s, (n, k) in suffix.items()}
    mu = {d: post[d.split(".")[-1]] for d in domain}
    m = level(domain, mu)
    post = {d: (mu[d] * m + k) / (n + m) for d, (n, k) in domain.items()}
    hosts = {h: (n, k) for h, _, _, n, k in rows}
    mu = {h: post[d] for h, d, _, _, _ in rows}
    m = level(hosts, mu)
    for h, (n, k) in hosts.items():
        a, b = mu[h] * m + k, (1 - mu[h]) * m + n - k
        assert got[h] == pytest.approx((a / (a + b), (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5))


# ---- 4


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        full = {s for s in free if left * w[s] / total >= repeats * sizes[s]}
        if not full:
            return out | {s: left * w[s] / total for s in free}
        out |= {s: repeats * sizes[s] for s in full}
        left -= sum(repeats * sizes[s] for s in full)
        free -= full
    return out


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mix_meets_targets(which, request):
    df = request.getfixturevalue(which)
    rows = fair_mix.mix(df).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    again = fair_mix.mix(df).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert collections.Counter(rows) == collections.Counter(again)
    assert collections.Counter((r.doc_id, r["size"]) for r in rows) == collections.Counter((i, len(WORD.findall(t))) for i, t in texts_of(df))
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r["size"]
    wanted = plain_targets(sizes)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(wanted[s]) and 0 <= r.taken <= 2 * r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - wanted[s]) <= len(sizes) + 1


def test_mix_is_a_queue(docs):
    rows = fair_mix.mix(docs).collect()
    for s in {r.source for r in rows}:
        own = sorted((r for r in rows if r.source == s and r["size"]), key=lambda r: (r.h, r.doc_id))
        assert [r.before for r in own] == list(np.cumsum([0] + [r["size"] for r in own])[:-1])
        rest = sum(r.taken for r in own)
        first = [min(r["size"], max(0, rest - r.before)) for r in own]
        second = [min(r["size"], max(0, rest - r.source_size - r.before)) for r in own]
        assert [r.taken for r in own] == [a + b for a, b in zip(first, second)]


def test_mixed_documents_hold_the_words_taken(odd):
    want = collections.Counter()
    for r in fair_mix.mix(odd).collect():
        want[r.doc_id] += r.taken
    got = collections.Counter()
    for r in fair_mix.mixed_documents(odd).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert got == +want


# ---- 5


def test_article_is_kept_and_the_rest_goes():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><div class="menu"><ul><li><a href=x>One</a><li><a>Two</a></ul></div>
    <div id=cookie-notice><p>We use cookies, and more, and more, for you.</p></div><div class="wrap"><article><header><h1>Title &amp; more</h1><span>12 May</span></header><p>First, with a <a href=x>link</a>,
    and <b>bold<br>text</b> &lt;here&gt;.<p>Second &eacute; paragraph, longer than the others, with commas, so it scores.</p><script>var t="</p><p>no</p>";</script><div class="ad-box">Buy, now, it is, cheap, today</div>
    <ul><li>Item one, plain</li><li>Item two</li></ul><form><input><p>Sign, up, here</p></form></article></div><aside><p>Side, bar, text, with, commas, and, length, enough</p></aside>
    <section class="comments"><p>I agree, yes, very much, indeed, a long comment, longer, than, the article</p></section><footer>&copy; me</footer>"""
    assert tree_extract.main_text(page).split("\n\n") == [
        "Title & more", "First, with a link, and bold text <here>.", "Second é paragraph, longer than the others, with commas, so it scores.", "Item one, plain", "Item two",
    ]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "text only", "<p>a</p", "</div></p>", "<div" * 5000, "<p>" * 3000 + "x", "<a href='x>y", "&am", "<!-- open"])
def test_odd_pages_do_not_fail(page):
    assert isinstance(tree_extract.main_text(page), str)


def test_pages_equal_plain_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in tree_extract.extract(pages).collect()}
    import html

    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        inner = re.sub(r"<[^>]*>?", "", re.sub(r"<br>", " ", re.sub(r"<(h1|/h1|p|/p)>", "\x01", inner)))
        text = "\n\n".join(b for b in (" ".join(html.unescape(x).split()) for x in inner.split("\x01")) if b)
        assert got[r.page_id] == (r.url, text, len(text))


# ---- 6


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 4608, 4609, 73_728, 73_729, 400_000])
def test_streams_round_trip(size):
    payload = transport_stream.padded(bytes(random.Random(size).randbytes(size)))
    stream = transport_stream.mux(payload)
    found = transport_stream.demux(stream)
    assert found["payload"] == payload and found["breaks"] == 0 and len(stream) % 188 == 0
    assert all(whole for *_, whole in found["units"])
    assert [t for t, *_ in found["units"]] == [i * transport_stream.TICKS for i in range(len(found["units"]))]
    assert [i for i, u in enumerate(found["units"]) if u[2]] == list(range(0, len(found["units"]), transport_stream.GROUP))


def test_lost_and_damaged_packets_show():
    stream = bytearray(transport_stream.mux(transport_stream.padded(b"x" * 30_000)))
    assert transport_stream.demux(bytes(stream[: 188 * 5] + stream[188 * 6 :]))["breaks"] == 1
    stream[20] ^= 1
    with pytest.raises(ValueError):
        transport_stream.demux(bytes(stream))


def plain_stream(stream):
    """Payload and time stamps of the one stream in packets, read byte by byte."""
    pes, out, stamps = {}, [], []
    program = media = None
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        pid, body = (p[1] & 31) << 8 | p[2], p[4 + (p[4] + 1 if p[3] & 32 else 0) :]
        if pid == 0:
            program = (body[11] & 31) << 8 | body[12]
        elif pid == program:
            media = (body[14] & 31) << 8 | body[15]
        elif pid == media:
            if p[1] & 64:
                pes[len(pes)] = b""
            pes[len(pes) - 1] += body
    for unit in pes.values():
        assert unit[:4] == b"\0\0\1\xbd"
        out.append(unit[9 + unit[8] : 6 + int.from_bytes(unit[4:6], "big")])
        bits = "".join(f"{b:08b}" for b in unit[9:14])
        stamps.append(int(bits[4:7] + bits[8:23] + bits[24:39], 2))
    return b"".join(out), stamps


@pytest.mark.parametrize("size", [0, 577, 73_729])
def test_streams_equal_a_plain_reader(size):
    payload = transport_stream.padded(bytes(random.Random(size).randbytes(size)))
    stream = transport_stream.mux(payload)
    raw, stamps = plain_stream(stream)
    found = transport_stream.demux(stream)
    assert (found["payload"], [t for t, *_ in found["units"]]) == (raw, stamps) == (payload, stamps)


def packet(pid, counter, data, start=False, field=b""):
    """One packet; short data is filled up by the adaptation field."""
    room = 184 - len(data)
    adaptation = bytes([room - 1]) + (field or b"\0" if room > 1 else b"") if room else b""
    return (bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if room else 0x10) | counter % 16]) + adaptation.ljust(room, b"\xff") + data).ljust(188, b"\xff")


def section(table, extension, body):
    raw = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, extension >> 8, extension & 255, 0xC1, 0, 0]) + body
    return raw + transport_stream.crc32_mpeg(raw).to_bytes(4, "big")


def test_programs_streams_and_sections_over_packets():
    """Two programs, three streams, a map table of several packets, a packet sent twice, and a break inside one unit."""
    pids = lambda number, pid: bytes([number >> 8, number & 255, 0xE0 | pid >> 8, pid & 255])
    stream = lambda kind, pid, info=b"": bytes([kind, 0xE0 | pid >> 8, pid & 255, 0xF0 | len(info) >> 8, len(info) & 255]) + info
    association = section(0, 1, pids(0, 0x10) + pids(1, 0x100) + pids(2, 0x200))
    first = section(2, 1, b"\xe1\x01\xf0\0" + stream(0x1B, 0x101, b"i" * 200) + stream(0x0F, 0x102, b"j" * 150))
    second = section(2, 2, b"\xe2\x01\xf0\0" + stream(6, 0x201))
    head = b"\0" + first
    out = [packet(0, 0, b"\0" + association, True), packet(0x100, 0, head[:184], True), packet(0x100, 1, head[184:368]), packet(0x100, 2, (head[368:] + b"\xff" * 184)[:184]), packet(0x200, 0, b"\0" + second, True)]
    pes = lambda data: b"\0\0\1\xe0" + (len(data) + 3).to_bytes(2, "big") + b"\x80\0\0" + data
    a, b = pes(b"A" * 300), pes(b"B" * 100)
    out += [packet(0x101, 5, a[:184], True), packet(0x102, 9, b, True), packet(0x101, 6, a[184:]), packet(0x101, 6, a[184:])]
    c = pes(b"C" * 500)
    out += [packet(0x201, 0, c[:184], True), packet(0x201, 2, c[184:368]), packet(0x201, 3, c[368:]), packet(0x201, 4, pes(b"D"), True), packet(0x201, 9, pes(b"E"), True, b"\x80")]
    found = transport_stream.demux(b"".join(out))
    assert found["programs"] == {1: {0x101: (0x1B, 0x100), 0x102: (0x0F, 0x100)}, 2: {0x201: (6, 0x200)}}
    assert {p: s["payload"] for p, s in found["streams"].items()} == {0x101: b"A" * 300, 0x102: b"B" * 100, 0x201: b"C" * 500 + b"DE"}
    assert [u[3] for u in found["streams"][0x201]["units"]] == [False, True, True] and found["streams"][0x101]["breaks"] == 0 and found["breaks"] == 1
    assert found["pid"] == 0x101 and all(u[0] is None for u in found["units"])


def test_media_columns(odd):
    got = collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in transport_stream.described(transport_stream.store(odd)).collect())
    want = collections.Counter()
    for i, t in texts_of(odd):
        raw = t.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want[(i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))] += 1
    assert got == want


# ---- 7


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_ids_equal_the_library(which, request, tiktoken_encoding):
    df = request.getfixturevalue(which)
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect())
    want = collections.Counter()
    for i, t in texts_of(df):
        ids = tiktoken_encoding.encode_ordinary(t)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), tuple(ids))] += 1
    assert got == want


def test_odd_texts_equal_the_library(tiktoken_encoding):
    codec = bpe._codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    chance = random.Random(1)
    texts = ["".join(chance.choice("  \n\t\x1c\x85\xa0'sdrevlt²½ªéA1_-　中💥́ſK×÷") for _ in range(chance.randint(0, 60))) for _ in range(1500)] + ["a" * 5000, " " * 3000 + "x", "l'll'VE 'd", "'"]
    assert codec.encoded(texts) == [",".join(map(str, tiktoken_encoding.encode_ordinary(t))) for t in texts]
    assert [codec.decoded(x).decode() for x in codec.encoded(texts)] == texts


def test_long_pieces_equal_the_library_in_good_time(tiktoken_encoding):
    import time

    codec = bpe.Codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    chance = random.Random(2)
    texts = ["".join(chance.choice("etaoinshr") for _ in range(n)) for n in (511, 512, 513, 1025, 20_000)] + ["a" * 30_000, "中" * 5000]
    assert codec.encoded(texts) == [",".join(map(str, tiktoken_encoding.encode_ordinary(t))) for t in texts]
    started = time.time()
    long = "".join(chance.choice("etaoinshrdlu") for _ in range(100_000))
    assert codec.decoded(codec.encoded([long])[0]).decode() == long and time.time() - started < 8


def test_decode_gives_the_bytes_back(docs):
    ids = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    both = bpe.decode(ids, RANKS, public_tokenizers.PATTERN).select(F.sha2("decoded", 256).alias("d"), "decoded_sha256")
    assert both.filter("d <> decoded_sha256").count() == 0


# ---- 8


def test_classifier_separates_held_out_rows(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r.doc_id: r.kept for r in importance.classify(docs, labels, keep=["doc_id"]).collect()}
    assert len(kept) == docs.count()
    rows = labels.collect()
    good = [kept[r.doc_id] for r in rows if r.quality == 1]
    bad = [kept[r.doc_id] for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def plain_grams(text):
    """Words, pairs of words, shapes and pairs of shapes of a text, one n-gram at a time."""
    kind = lambda b: 2 if 65 <= b < 91 else 3 if 97 <= b < 123 or b >= 128 else 4 if 48 <= b < 58 else 5 if b in b".,;:" else 1
    words, shapes = ["".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(text)], []
    for i, w in enumerate(WORD.findall(text)):
        raw = w.encode()
        shapes.append((kind(raw[0]), kind(raw[min(1, len(raw) - 1)]), kind(raw[max(len(raw) - 2, 0)]), kind(raw[-1]), i > 0 and words[i] == words[i - 1]))
    return [words, list(zip(words, words[1:])), shapes, list(zip(shapes, shapes[1:]))]


def test_weights_equal_plain_counts(spark):
    texts = ["Aa bb bb cc", "Aa bb!! $$$ cc", "", "x", " ".join(f"w{i} the" for i in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    grams = [plain_grams(t) for t in texts]
    expected = np.zeros(len(texts))
    for order in range(4):
        raw, own = collections.Counter(g for some in grams for g in some[order]), collections.Counter(grams[0][order])
        share = sum(own.values()) / sum(raw.values())
        for i, some in enumerate(grams):
            ratios = [np.log((own[g] + importance.SMOOTHING) / (raw[g] * share + importance.SMOOTHING)) for g in some[order]]
            expected[i] += min(importance.EVIDENCE, len(some[0])) * sum(ratios) / max(1, len(ratios))
    ratios = importance.log_ratios(importance.counts(df, spark.createDataFrame([(0,)], "doc_id bigint")))
    rows = importance.scored(df, ratios).collect()
    # A few of the 200 words share a bucket by chance; the other texts have none that do.
    assert [r.log_weight for r in sorted(rows, key=lambda r: r.doc_id)][:4] == pytest.approx(list(expected[:4]))
    assert sorted(rows, key=lambda r: r.doc_id)[4].log_weight == pytest.approx(expected[4], rel=0.1)


def test_kept_are_the_drawn_top_k(spark, docs, sf_dir):
    """k is the number of rows that weigh like all but a share of the held-out good ones; the rows kept are those of the k largest keys."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = importance.classify(docs, labels, recall=0.9, keep=["doc_id"]).collect()
    sample = importance.label_sample(labels, importance.SAMPLE).collect()
    weight = {r.doc_id: r.log_weight for r in rows}
    held = sorted(weight[r.doc_id] for r in sample if r.fold == 1 and r.good and r.doc_id in weight)
    k = sum(r.log_weight >= held[int(len(held) * (1 - 0.9))] for r in rows)
    keys = sorted((r.key for r in rows), reverse=True)
    assert all(r.kept == (r.key >= keys[k - 1]) for r in rows)
    # The draw has a say: some rows kept weigh less than some that are not.
    assert min(r.log_weight for r in rows if r.kept) < max(r.log_weight for r in rows if not r.kept)


def test_words_alone_separate(spark, sf_dir, docs, monkeypatch):
    """Shapes off: word models still tell good rows from bad."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratios, _ = importance.fitted(docs, labels)
    ratios[2:] = 0
    weight = {r.doc_id: r.log_weight for r in importance.scored(docs, ratios, ["doc_id"]).collect()}
    rows = labels.collect()
    good = sorted(weight[r.doc_id] for r in rows if r.quality == 1 and r.doc_id in weight)
    bad = [weight[r.doc_id] for r in rows if r.quality == 0 and r.doc_id in weight]
    assert sum(b < good[len(good) // 20] for b in bad) >= 0.7 * len(bad)


def test_string_ids_and_clashing_names(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain = {r.doc_id: (r.kept, r.log_weight) for r in importance.classify(docs, labels, keep=["doc_id"]).collect()}
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", F.lit(1).alias("KEY"), F.lit("x").alias("scored_text"), F.lit(2).alias("keep_0"))
    text = labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    got = importance.classify(named, text)
    assert got.columns == ["doc_id", "text", "scored_text", "keep_0", "n_words", "log_weight", "key", "kept"]
    rows = got.collect()
    assert all((r.scored_text, r.keep_0) == ("x", 2) for r in rows)
    # Another sample is drawn, as ids hash differently; good rows stay all the same.
    assert sum(r.kept == plain[int(r.doc_id[1:])][0] for r in rows) >= 0.95 * len(rows)


def test_kth_largest(spark):
    values = [random.Random(2).gauss(0, 5) for _ in range(500)] + [1.5] * 40
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 7, 260, 540, 600):
        assert importance.kth_largest(df, k) == sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert importance.kth_largest(df.limit(0), 3) == float("-inf")


def test_classifier_takes_given_k(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = importance.classify(docs, labels, k=50, keep=["doc_id"]).collect()
    keys = sorted((r.key for r in rows), reverse=True)
    assert all(r.kept == (r.key >= keys[49]) for r in rows)


# ---- 9


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_rule_statistics_equal_plain_counts(spark, which, request):
    df = request.getfixturevalue(which)
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in isolation.rule_statistics(df).collect())
    want = collections.Counter()
    for i, text in texts_of(df):
        words = WORD.findall(text)
        seen = collections.Counter(zip(words, words[1:], words[2:]))
        marked = {k for j in range(len(words) - 2) if seen[tuple(words[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want[(i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked))] += 1
    assert got == want


def test_forest_isolates_outliers():
    chance = np.random.default_rng(5)
    rows = chance.normal(0.2, 0.02, (500, 4))
    forest = isolation.grow(rows, np.zeros(4), np.ones(4))
    near, far = isolation.anomaly(forest, rows), isolation.anomaly(forest, np.full((1, 4), 0.9))
    assert far[0] > np.quantile(near, 0.999)
    assert far[0] == isolation.anomaly(isolation.grow(rows, np.zeros(4), np.ones(4)), np.full((1, 4), 0.9))[0]


def test_anomaly_scores_equal_a_walk_down_each_tree():
    chance = np.random.default_rng(6)
    rows = chance.random((80, 4))
    forest = isolation.grow(rows, np.zeros(4), np.ones(4), trees=7, per_tree=32)
    for row, score in zip(rows, isolation.anomaly(forest, rows)):
        total = 0.0
        for t in range(7):
            node = 0
            while forest["feature"][t, node] >= 0:
                node = forest["left"][t, node] + int(row[forest["feature"][t, node]] > forest["split"][t, node])
            total += forest["path"][t, node]
        assert score == pytest.approx(2 ** -(total / 7 / float(forest["norm"])))


def test_unlabelled_kinds_of_anomalies_go(spark):
    chance = random.Random(8)
    words = ["".join(chance.choice("etaoinshrdlu") for _ in range(chance.choice((2, 3, 4, 5, 6, 7, 9)))) for _ in range(3000)]
    some = lambda n: [chance.choice(words) for _ in range(n)]
    prose = lambda: ".\n".join(" ".join(some(12)).capitalize() for _ in range(chance.randint(10, 60)))
    rows = [(i, prose(), "en", "s", 1) for i in range(1500)]
    rows += [(2000 + i, "\n".join(" ".join(some(5)) + "\nMenu" for _ in range(60)), "en", "s", 1) for i in range(5)]
    rows += [(3000 + i, " ".join("".join(some(6)) for _ in range(100)), "en", "s", 1) for i in range(5)]
    rows += [(4000 + i, " ".join("".join(some(14))), "en", "s", 1) for i in range(5)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1200)], "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r for r in isolation.judge(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert not any(r.base_failed for r in found.values())
    assert [i for i, r in found.items() if i >= 2000 and r.kept] == []
    assert sum(r.kept for i, r in found.items() if i < 1500) >= 0.98 * 1500


def test_repeated_ids_leave_the_sample_whole(spark):
    """Where ids repeat, no labelled document falls out of the sample, whatever its length."""
    chance = random.Random(3)
    text = lambda n: " ".join(chance.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + chance.choice("abc") for _ in range(n))
    rows = [(i % 40, text(60 + 40 * (i % 40)), "en", "s", 1) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    got = isolation.judge(spark.createDataFrame(rows, DOCS), labels, bound=40).collect()
    passed = [r for r in got if not r.base_failed]
    assert len(got) == 400 and sum(r.kept for r in passed) >= 0.9 * len(passed)
    assert {r.doc_id for r in passed if r.kept} == {r.doc_id for r in passed}


def test_verdicts_follow_from_the_threshold(spark, sf_dir, docs):
    """``kept`` from plain sums: the held-out good rows set the threshold, scores decide."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = isolation.judge(docs, labels, recall=0.9).collect()
    sample = {r.doc_id: r for r in isolation.label_sample(labels, isolation.SAMPLE).collect()}
    held = sorted(r.score for r in rows if not r.base_failed and r.doc_id in sample and sample[r.doc_id].good and sample[r.doc_id].fold == 1)
    threshold = held[min(len(held) - 1, int(np.ceil(len(held) * 0.9)))]
    assert all(r.kept == (not r.base_failed and r.score <= threshold) for r in rows)
    assert any(not r.kept and not r.base_failed for r in rows)


def test_rules_keep_good_rows(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = {r.doc_id: r for r in isolation.judge(docs, labels).collect()}
    assert len(rows) == docs.count() and not any(r.kept and r.base_failed for r in rows.values())
    good = [rows[r.doc_id].kept for r in labels.collect() if r.quality == 1 and not rows[r.doc_id].base_failed]
    assert sum(good) >= 0.97 * len(good)


# ---- 10


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(ids, fps):
    own = list(range(len(fps)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                own[b] = a
    first = {}
    for i, d in enumerate(ids):
        if d is not None:
            first[root(i)] = min(first.get(root(i), d), d)
    return [first.get(root(i)) for i in range(len(ids))]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_components_equal_all_pairs(which, request):
    df = request.getfixturevalue(which)
    rows = texts_of(df)
    fps = [plain_fingerprint(t) for _, t in rows]
    want = collections.Counter(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], plain_components([i for i, _ in rows], fps)))
    assert collections.Counter(map(tuple, simhash_pivot.near_duplicates(df).collect())) == want


@pytest.mark.parametrize("limit", [10_000, 16])
def test_dense_groups_lose_no_link(spark, monkeypatch, limit):
    """Fingerprints that differ by few bits, in groups above and below the limit."""
    monkeypatch.setattr(simhash_pivot, "LIMIT", limit)
    chance = random.Random(9)
    fps = set()
    for _ in range(6):
        centre = chance.getrandbits(64)
        for _ in range(40):
            f = centre
            for _ in range(chance.randint(0, 4)):
                f ^= 1 << chance.randrange(64)
            fps.add(f)
    fps |= {chance.getrandbits(64) for _ in range(100)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    prints = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id bigint, __fp bigint")
    named = {r.fp: r.component_id for r in simhash_pivot.grouped(prints).collect()}
    assert [named[f] for f in signed] == plain_components(list(range(len(signed))), [f & (1 << 64) - 1 for f in signed])


def test_tables_meet_every_close_pair():
    """At every level some block of a close pair is equal, and so is its key."""
    chance = random.Random(5)
    for _ in range(100):
        a = chance.getrandbits(64)
        b = a
        for bit in chance.sample(range(64), 4):
            b ^= 1 << bit
        pair = np.array([a, b], np.uint64)
        assert (np.abs(np.diff(simhash_pivot.coordinates(pair).astype(int), axis=1)) <= 4).all()
        paths = {0: np.zeros(2, np.uint64)}
        for _ in range(4):
            met = [(p, k) for path, keys in paths.items() for p, k in simhash_pivot.split_keys(path, keys, pair) if k[0] == k[1]]
            assert met
            paths = dict(met)


def jaccard(a, b, words=5):
    def grams(text):
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text))
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_shingle_sets_equal_plain_ones(docs, odd):
    import pyarrow as pa

    for df in (docs.limit(60), odd):
        texts = [r.text for r in df.select("text").collect()]
        hashes, rows = near_copies.shingles(pa.array(texts, pa.string()), 5)
        plain = []
        for t in texts:
            w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
            plain.append(len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0)
        assert np.bincount(rows, minlength=len(texts)).tolist() == plain


def test_one_document_of_each_group_stays(odd):
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in near_copies.distinct_documents(odd).collect())
    # 1 and 2 are copies but for their case; 3, 4, 6 and a null id have no words.
    assert got == [(False, 1), (False, 3), (False, 5), (False, 7), (True, 0)]
    assert near_copies.distinct_documents(odd).columns == odd.columns


@pytest.mark.parametrize("limit", [2000, 8])
def test_near_copies_go_and_others_stay(spark, monkeypatch, limit):
    """Copies of similarity 0.8 and more are found, in groups below and above the limit; texts of less stay."""
    monkeypatch.setattr(near_copies, "LIMIT", limit)
    monkeypatch.setattr(near_copies, "SHINGLES", limit * 200)
    chance = random.Random(12)
    word = lambda: "".join(chance.choice("etaoinshrdlu") for _ in range(chance.randint(2, 8)))
    base = [[word() for _ in range(200)] for _ in range(30)]
    rows, near, apart = [], [], []
    for i, text in enumerate(base):
        rows.append((1000 * i, " ".join(text)))
        for k in range(12 if i % 3 else 2):
            copy = list(text)
            for _ in range(chance.choice([0, 1, 2, 3]) if k < 11 else 14):
                copy[chance.randrange(200)] = word()
            j = jaccard(" ".join(text), " ".join(copy))
            (near if j >= 0.8 else apart).append(1000 * i + k + 1)
            rows.append((1000 * i + k + 1, " ".join(copy)))
    kept = {r.doc_id for r in near_copies.distinct_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {1000 * i for i in range(30)} <= kept
    assert sum(i not in kept for i in near) >= 0.95 * len(near)
    texts = dict(rows)
    assert all(any(jaccard(texts[i], texts[j]) >= 0.8 for j in texts if j // 1000 == i // 1000 and j != i) for i in apart if i not in kept)


def test_search_links_what_all_pairs_link():
    """Forests of small sets, some rows linked beforehand, against all pairs."""
    chance = random.Random(21)
    for _ in range(30):
        n = chance.randint(1, 25)
        sets = [np.unique(np.array([chance.randint(0, 12) for _ in range(chance.randint(1, 12))], np.int64)) for _ in range(n)]
        labels = np.array([chance.choice([i, 3]) for i in range(n)])
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
        found = list(near_copies.verified(np.zeros((n, 4), np.uint64), np.concatenate(sets), offsets, labels, 0.5))
        sims = {(i, j) for i in range(n) for j in range(n) if len(set(sets[i]) & set(sets[j])) >= 0.5 * len(set(sets[i]) | set(sets[j]))}
        assert set(found) <= sims and len(found) < n
        groups = [np.arange(n), np.arange(n)]
        for own, pairs in zip(groups, (found, sims)):
            for a, b in [*pairs, *((i, j) for i in range(n) for j in range(n) if labels[i] == labels[j])]:
                own[own == own[a]] = own[b]
        assert all((groups[0][i] == groups[0][j]) == (groups[1][i] == groups[1][j]) for i in range(n) for j in range(n))


def test_large_groups_of_near_copies_take_few_comparisons(spark):
    """A thousand near copies of one text: the tables and the search give about a row a copy."""
    chance = random.Random(13)
    base = [f"w{chance.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(1000):
        copy = list(base)
        for _ in range(chance.randint(0, 2)):
            copy[chance.randrange(120)] = f"x{chance.randrange(10**6)}"
        rows.append((i, i, " ".join(copy)))
    texts = spark.createDataFrame(rows, "row bigint, doc_id bigint, text string")
    groups = collections.Counter(r.group for r in near_copies.grouped(texts, 5, 0.8).collect())
    assert max(groups.values()) >= 995


def test_recall_against_brute_force(spark, docs):
    """Links of whole tables: nearly all pairs of similarity 0.8 or more end in one group, and no group has a text without one."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    texts = [(r.row, r.text) for r in rows.collect()]
    group = {r.row: r.group for r in near_copies.grouped(spark.createDataFrame(rows.collect(), "row bigint, doc_id bigint, text string"), 5, 0.8).collect()}
    pairs = [(a, b) for k, (a, s) in enumerate(texts) for b, t in texts[:k] if jaccard(s or "", t or "") >= 0.8]
    assert sum(group[a] == group[b] for a, b in pairs) >= 0.95 * len(pairs)
    linked = {x for p in pairs for x in p}
    sizes = collections.Counter(group.values())
    assert all(sizes[g] == 1 or r in linked for r, g in group.items())


# ---- all


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, sf_dir, tmp_path, name):
    for t in ("documents", "pages", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_all_rows(spark, sf_dir, name):
    table = "pages" if name.split("_")[0] in ("op2", "op3", "op5") else "documents"
    assert queries.QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_odd_rows_pass_through_every_judge(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, None, None), (1, None, 1)], "doc_id bigint, quality int, toxic int")
    assert importance.classify(odd, labels, keep=["doc_id"]).count() == odd.count()
    assert isolation.judge(odd, labels).count() == odd.count()


def test_every_label_is_read(spark):
    """More labels than any sample took: all fit or calibrate, and trees draw from all rows."""
    labels = spark.range(20_100).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    for module in (importance, isolation):
        assert module.label_sample(labels, module.SAMPLE).count() == 20_100
    rows = spark.range(500).select(F.col("id").cast("string").alias("sample_id"), *(((F.col("id") + 1) if s != "n_symbols" else F.lit(0)).cast("bigint").alias(s) for s in isolation.STATISTICS))
    assert sorted(r.number for r in isolation.numbered(rows).collect()) == list(range(500))
    values, chosen = isolation.tree_rows(rows, 500, trees=30, per_tree=16)
    assert all(len(set(c.tolist())) == 16 for c in chosen) and len(values) > 300  # of 480 draws out of 500 rows
    assert len(np.unique(values, axis=0)) == len(values)
    assert isolation.tree_rows(rows, 500, trees=40, per_tree=16)[0].shape[0] == 500


def _shuffled(spark) -> int:
    """Bytes that all stages of the session have written for a shuffle."""
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_only_target_texts_are_shuffled(spark):
    """Where ids are too many to broadcast: one text in ten is the target's, and the others stay where they are read."""
    words = np.random.default_rng(3).integers(10**8, 10**8 + 10, (2000, 200))  # ten words, so counts of buckets are few
    docs = spark.createDataFrame([(i, " ".join(map(str, row))) for i, row in enumerate(words.tolist())], "doc_id bigint, text string")
    target = spark.range(0, 2000, 10).select(F.col("id").alias("doc_id"))
    before, limit = _shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    docs.repartition(3, "doc_id").write.format("noop").mode("overwrite").save()
    texts = _shuffled(spark) - before
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = importance.counts(docs, target)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert _shuffled(spark) - before - texts < texts / 2
    mine = importance.counts(docs.filter("doc_id % 10 = 0"), target)
    assert (found[1] == mine[0]).all() and (found[1] == mine[1]).all() and found[0].sum() == 2000 * (200 + 199) * 2
