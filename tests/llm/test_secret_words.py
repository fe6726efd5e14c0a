"""Plain words after a credential context are no secrets."""

import random

from newsweave.llm import secret_scan

PLAIN = ["secret is something", "password is incorrect", "token is generated", "token: understanding", "the secret is brindlewort here"]
REAL = ["password is xK9$mQ2vLp8#", "token: qzjxvkwpyhgf"]


def test_prose_gives_no_span_and_no_other_document_matters(spark):
    prose = ["we found brindlewort and other things"] * 6
    copies = [f"{REAL[1]} end"] * 6  # copies of a secret don't make it a word
    rows = list(enumerate([*PLAIN, *REAL, *prose, *copies]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = {r.doc_id: r.n_guess for r in secret_scan.scan(docs).collect()}
    assert [n[k] for k in range(len(PLAIN))] == [0] * len(PLAIN)
    assert [n[k] for k in range(len(PLAIN), len(PLAIN) + len(REAL))] == [1] * len(REAL)
    alone = [r.n_guess for k in range(len(rows)) for r in secret_scan.scan(docs.where(f"doc_id = {k}")).collect() if k < 7]
    assert alone == [n[k] for k in range(7)]
    kept = {r.doc_id: r.text for r in secret_scan.redact(docs, length=None).collect()}
    # 'token: understanding' is a span of the fixed detector assign
    assert [kept[k] for k in range(len(PLAIN)) if k != 3] == PLAIN[:3] + PLAIN[4:]
    assert secret_scan.redact(docs.limit(0), length=None).count() == 0


def planted(rng):
    """Texts with a secret, and texts with something else in the same contexts."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    lower, mixed, marks = "abcdefghijklmnopqrstuvwxyz", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", "!#%&*+-/=?@^_~"
    contexts = ["password: ", "passwd=", "pin: ", "login is ", "the secret is ", "token = \"", "api key: ", "Passphrase is ", "pwd='", "credentials: "]
    secrets = []
    for _ in range(40):
        secrets += [pick(mixed, 10), pick(mixed, 12) + rng.choice(marks), pick(lower, 4) + pick(marks, 2) + pick(mixed, 5), pick(lower, 14), "é" + pick(mixed, 9) + "ñ"]
    others = [
        "os.environ['X']", "192.168.100.200", "2024-01-31T10:22", "YOUR_API_KEY_HERE", "Rindfleischetikettierung", "https://example.com/reset", "user@example.com",
        "config.database.password", "getpass.getpass()", "********", "xxxxxxxxxx", "password", "incorrect", "required", "administrator", "1234567890", "qwertyuiop",
        "abcabcabc", "20240131", "${TOKEN}", "<hidden>", "{{ secret }}", "undefined", "Internationalisierung", "developpement", "contraseña", "2024-01-31", "10:22:31",
        "your-password", "settings.SECRET_KEY", "2001:db8::1:2:3", "sunshine", "letmein1", "football2024", "asdfghjkl", "understanding", "inconnues", "unveränderlich",
    ]
    return [(rng.choice(contexts), v) for v in secrets], [(rng.choice(contexts), v) for v in others * 5]


def test_precision_and_recall_on_planted_values():
    real, other = planted(random.Random(11))
    words = secret_scan.dictionary()
    found = sum(secret_scan.guess_spans(f"so {c}{v} then", words=words) == [(3 + len(c), 3, 3 + len(c) + len(v))] for c, v in real)
    false = sum(bool(secret_scan.guess_spans(f"so {c}{v} then", words=words)) for c, v in other)
    print(found, len(real), false, len(other))
    assert found >= 0.97 * len(real) and false <= 0.02 * len(other)


def test_values_reach_to_the_next_blank():
    words = secret_scan.dictionary()
    assert secret_scan.redacted("password: motdepasse1!Zqé9Xk end", words=words) == "password: [SECRET] end"
    assert secret_scan.redacted("password: motdepasse1Zq!9é漢Xk", words=words) == "[SECRET]"  # of assign, and to the end
    assert secret_scan.redacted("passwd is «Zq!9é漢Xk7», then", words=words) == "passwd is «[SECRET]», then"


def test_contexts_begin_at_words_and_references_are_no_secrets():
    words = {**secret_scan._WORDS, "reset": 8.0, "international": 9.0, "isierung": 12.0}
    for text in (
        "spin: characteristically", "password: https://example.com/reset", "login: some.body@example.com", "token: ${SERVICE_TOKEN}",
        "password: <yourpassword>", "the secret is Internationalisierung", "password: ********",
    ):
        assert secret_scan.guess_spans(text, words=words) == [], text
    for text in ("pin: 83x91Kq7!zz", "db_password = xK9mQ2vLp8", "password is xK9$mQ2vLp8#", "token: https://user:xK9mQ2@example.com/"):
        assert len(secret_scan.guess_spans(text, words=words)) == 1, text


def test_guess_cost_equals_the_least_of_all_segmentations():
    words = {"pass": 3.0, "word": 5.0, "sword": 6.0}

    def brute(value, i=0):  # brute-force characters and words only; no repeats, walks and dates in these values
        def cost(seg):
            letters = len(seg) * secret_scan.alphabet(value)
            return min(1 + letters, 1 + words[seg] if seg in words else 1 + letters)

        return 0.0 if i == len(value) else min(cost(value[i:j]) + brute(value, j) for j in range(i + 1, len(value) + 1))

    for value in ("password", "passzword", "gkbpass", "swordpqz", "bmpassword", "zmbqk"):
        assert abs(secret_scan.guess_bits(value, words) - brute(value)) < 1e-9, value
