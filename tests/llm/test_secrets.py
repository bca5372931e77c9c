import hashlib
import math
import random

from kinora.llm import secrets

RNG = random.Random(11)
HEX = "0123456789abcdef"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def word(letters, n):
    return "".join(RNG.choice(letters) for _ in range(n))


def test_base_spans_by_kind_and_order():
    key, run = "AKIA" + word(UPPER, 16), word(HEX, 40)
    text = f'ünï token = "{run}" x {key} API_KEY:abc12 pass\x0bword=zzzzzz Secret=qwerty! AKIA123'
    spans = secrets.base_spans(text)
    assert [k for k, _, _ in spans] == ["assign", "hex", "access", "assign"]
    assert text[spans[1][1] : spans[1][2]] == run and text[spans[2][1] : spans[2][2]] == key
    assert secrets.credential(text, spans[0]) == run and text[spans[3][1] : spans[3][2]] == "Secret=qwerty"


def test_letters_outside_ascii_do_not_stand_for_keyword_letters():
    assert secrets.base_spans("paſſword=abcdefgh toKen=abcdefgh") == []


def test_a_short_value_uses_up_its_match():
    assert secrets.base_spans("token=a secret=b token=token=abcdef") == [("assign", 17, 35)]


def test_merged_automata_tell_formats_apart():
    formats = secrets.Formats(
        {"hex": [word(HEX, 40) for _ in range(200)], "access": ["AKIA" + word(UPPER, 16) for _ in range(200)]},
        [word("0123456789", 16) for _ in range(200)] + ["release-" + word("0123456789", 8) for _ in range(200)],
    )
    assert all(formats.score(word(HEX, 36) + "a1b2") > secrets.MARGIN for _ in range(50))
    assert all(formats.score(word("0123456789", 16)) < 0 for _ in range(50))
    assert formats.score("release-20240101") < 0
    automaton = formats.kinds["access"]
    assert automaton.log_likelihood("AKIA" + word(UPPER, 16)) > automaton.log_likelihood(word(HEX, 20))


def test_compatible_states_are_merged():
    automaton = secrets.Automaton.infer(["d" * n for n in range(1, 60)] * 5)
    reached, todo = {0}, [0]
    while todo:
        for to, _ in automaton.next[todo.pop()].values():
            if to not in reached:
                reached.add(to)
                todo.append(to)
    assert len(reached) < 20


def test_tokens_are_read_whole():
    def lead():
        return word("QRSTUVW", 69) + "7"

    formats = secrets.Formats({"assign": [lead() + word(HEX, 20) for _ in range(200)]}, [lead() + "-" + word("ghijklmnop", 29) for _ in range(200)])
    secret, path = lead() + word(HEX, 20), lead() + "-" + word("ghijklmnop", 29)
    assert formats.score(secret) > secrets.MARGIN and formats.score(path) < 0
    assert secrets.redacted(f"x {secret} {path} y", formats) == f"x [REDACTED] {path} y"
    automaton = formats.kinds["assign"]
    text = lead() + "-/" + word(HEX, 20) + "--/"
    by_character = sum(math.log(0.1) for _ in range(25 + 1)) - sum(math.log(secrets._SIZES.get(c, 1)) for c in secrets.classes(text[70:]))
    before = secrets.classes(text[:70])
    at, total = 0, 0.0
    for c in before:
        to, n = automaton.next[at][c]
        total += math.log((n + 0.01) / (automaton.visits[at] + 0.1)) - math.log(secrets._SIZES[c])
        at = to
    total += math.log(0.01 / (automaton.visits[at] + 0.1)) - math.log(0.1)
    assert math.isclose(automaton.log_likelihood(text), total + by_character)


def plain_base(text):
    """The fixed patterns by going over the characters, without regular expressions."""
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)

    def run(at, letters):
        end = at
        while end < len(text) and text[end] in letters:
            end += 1
        return end

    out, at = [], 0
    while at < len(text):
        name = next((w for w in ("password", "passwd", "secret", "token", "apikey", "api_key") if lower.startswith(w, at)), None)
        if name:
            k = at + len(name)
            k = run(k + (text[k : k + 1] in ("'", '"')), " ")
            if text[k : k + 1] in (":", "="):
                k = run(k + 1, " ")
                k += text[k : k + 1] in ("'", '"')
                end = run(k, value)
                if end > k:
                    out += [("assign", at, end)] if end - k >= 6 else []
                    at = end
                    continue
        at += 1
    for kind, lead, letters, least in (("access", "AKIA", set(UPPER) | set("0189"), 20), ("hex", "", set(HEX), 24)):
        at = 0
        while at < len(text):
            end = run(at + len(lead), letters) if text.startswith(lead, at) else at
            if end > at + len(lead):
                out += [(kind, at, end)] if end - at >= least else []
                at = end
            else:
                at += 1
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_base_spans_equal_a_plain_version():
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "=", ":", "é", "\n", ".", "AKIA", "AKI"]
    for _ in range(3000):
        more = [word("abc9/", RNG.randint(1, 9)), word(HEX, RNG.randint(20, 30)), "AKIA" + word(UPPER, RNG.randint(10, 20))]
        text = "".join(RNG.choice(parts + more * 3) for _ in range(RNG.randint(1, 14)))
        assert secrets.base_spans(text) == plain_base(text), text


def plain_tokens(text, base):
    """Tokens by going over the characters: runs of six or more that no base span covers, without dots at their ends."""
    letters = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    covered = {p for _, a, b in base for p in range(a, b)}
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in letters and end not in covered:
            end += 1
        a, b = at, end
        while a < b and text[a] == ".":
            a += 1
        while a < b and text[b - 1] == ".":
            b -= 1
        if b - a >= 6:
            out.append((a, b))
        at = max(end, at + 1)
    return out


def test_tokens_of_any_kind_are_candidates():
    for _ in range(400):
        parts = [word("ab1.=- ü", RNG.randint(1, 12)), "token=" + word("xyz", 8), word(HEX, 30), "AKIA" + word(UPPER, 18), " "]
        text = "".join(RNG.choice(parts) for _ in range(RNG.randint(1, 8)))
        base = secrets.base_spans(text)
        assert secrets.candidates(text, base) == plain_tokens(text, base), (text, base)


def test_added_spans_equal_a_plain_version():
    """Letters alone, short ones, ones with a dot and what is left beside a base span, judged one by one."""
    formats = secrets.Formats({"assign": [word("QXZ", 5) + "." + word("QXZ", 5) for _ in range(100)] + [word("JKV", 9) for _ in range(100)]}, [word("aeiounrst", RNG.randint(6, 9)) for _ in range(300)])
    found = 0

    def ordinary(t):
        sizes = sum(n * any(c in letters for c in t) for letters, n in (("abcdefghijklmnopqrstuvwxyz", 26), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26), ("0123456789", 10), ("+/_.=-", 6)))
        return formats.ordinary["l"].log_likelihood(t) if t.isalpha() else -len(t) * math.log(sizes)

    assert set(formats.ordinary) == {"l"}
    for _ in range(100):
        some = [word("QXZ", 5) + "." + word("QXZ", 5), word("JKV", 9), word("aeiou", 8), "QXZ" + "token=abcdefgh", word("JKV", 9) + "/AKIA" + "A" * 16, "."]
        text = " ".join(RNG.choice(some) for _ in range(6))
        base = secrets.base_spans(text)
        scores = {t: max(a.log_likelihood(t) for a in formats.kinds.values()) - ordinary(t) for t in (text[a:b] for a, b in plain_tokens(text, base))}
        want = [("grammar", a, b) for a, b in plain_tokens(text, base) if scores[text[a:b]] >= math.log(1000)]
        assert formats.added(text, base) == want
        found += len(want)
    assert found > 100


def test_recall_and_precision_of_learned_formats(spark):
    """Bare credentials of the labelled formats among ordinary words, numbers, dates and addresses."""
    say = lambda: " ".join(RNG.choice([word("etaoinshrdlu", RNG.randint(2, 11)), word("0123456789", RNG.choice([3, 6, 16])), f"20{word('01', 2)}-{word('01', 2)}-{word('0123456789', 2)}", f"10.{word('12', 2)}.0.{word('12', 2)}"]) for _ in range(60))
    docs = [(k, f"{say()} password={word(HEX, 32)} {say()}") for k in range(150)] + [(1000 + k, f"{say()} {word(HEX, 20)} {say()}") for k in range(150)] + [(2000 + k, say()) for k in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.n_grammar for r in secrets.scan(df, secrets.learn(df)).collect()}
    assert sum(got[1000 + k] == 1 for k in range(150)) >= 145
    assert sum(got[2000 + k] for k in range(150)) + sum(got[k] for k in range(150)) <= 3


def test_a_sample_takes_whole_strings_in_any_order():
    strings = [word(HEX, RNG.randint(1, 300)) for _ in range(3000)]
    wanted = sorted({(hashlib.blake2b(s.encode(), digest_size=16).digest(), s) for s in strings})
    for count, chars in ((50, 10**9), (10**9, 5000)):
        kept = secrets.Smallest(count, chars)
        for s in strings + strings[::-1]:
            kept.add(s)
        got = kept.items()
        assert got == wanted[: len(got)] and (len(got) == count or sum(len(s) for _, s in got[:-1]) < chars <= sum(len(s) for _, s in got))


def test_long_strings_are_learned_whole(spark):
    found = [(k, f"password={word(HEX, 12)}.{word(UPPER, 90)} and {word('0123456789', 100)}") for k in range(5)]
    got = {(r.kind, r.string) for r in secrets.labelled_strings(spark.createDataFrame(found, "doc_id long, text string")).collect()}
    assert {len(s) for k, s in got if k == "assign"} == {103}


def test_strings_of_all_documents_are_collected(spark):
    docs = spark.range(10_000, 32_000).selectExpr("id doc_id", "concat('password=zz', id) text")
    assert secrets.labelled_strings(docs, strings=10**6).where("kind = 'assign'").count() == 22_000


def rows():
    for i in range(300):
        kind = i % 3
        secret = f"password={word(HEX, 18)}" if kind == 0 else f"AKIA{word(UPPER, 16)}" if kind == 1 else f'token = "{word(HEX, 40)}"'
        yield i, f"some ordinary words, card {word('0123456789', 16)} and {secret} then more"


def test_query_on_a_fixture(spark):
    found = [*rows(), (900, None), (901, ""), (None, "api-key: x"), (902, f"bare {word(HEX, 18)} here"), (902, "nothing " * 9000)]
    docs = spark.createDataFrame([(*r, "x") for r in found], "doc_id long, text string, spans string")
    formats = secrets.learn(docs)
    got = secrets.scan(docs, formats).collect()
    assert len(got) == len(found)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for doc_id, text in found[:300]:
        base = plain_base(text)
        (r,) = by[doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in secrets.KINDS[:3])
        assert r.base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest() and r.spans == secrets.joined(base)
    assert all(by[i][0].spans == "" for i in (900, 901))
    assert sorted(r.spans for r in by[902]) == ["", "grammar:5:23"]
    clean = {(r.doc_id, r.text) for r in secrets.redact(docs, formats).collect() if r.doc_id in (0, 900, 902)}
    assert (900, None) in clean and (902, "bare [REDACTED] here") in clean
    assert all("password=" not in (t or "") for _, t in clean)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    formats = secrets.learn(docs)
    assert formats.score("a" * 20) < 0 and secrets.scan(docs, formats).count() == 0
