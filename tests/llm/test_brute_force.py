"""Personal data and license notices against independent checks of every value and every window."""

import datetime
import random
import re

import pyarrow as pa
import pytest

from tallyspark.llm import licenses, pii


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def mod97(text):
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def real_date(text):
    for shape in ("%Y-%m-%d", "%d.%m.%Y", "%m.%d.%Y", "%d/%m/%Y", "%m/%d/%Y"):
        try:
            return 1900 <= datetime.datetime.strptime(text, shape).year <= 2099
        except ValueError:
            pass
    return False


def octets(text):
    return all(int(x) < 256 and str(int(x)) == x for x in text.split("."))


def number(text):
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def drawn(rng, kind):
    """A value in the shape of its kind, valid or not."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "card":
        body = rng.choice("3456") + d(14)
        text = body + (str(next(k for k in range(10) if luhn(body + str(k)))) if rng.random() < 0.6 else d(1))
        return text if rng.random() < 0.5 else " ".join(text[k : k + 4] for k in range(0, 16, 4))
    if kind == "iban":
        body = d(18)
        check = 98 - int(body + "131400") % 97 if rng.random() < 0.6 else rng.randrange(2, 99)
        text = f"DE{check:02d}{body}"
        return text if rng.random() < 0.5 else " ".join(text[k : k + 4] for k in range(0, 22, 4))
    if kind == "date":
        y, m, day = rng.randrange(1890, 2110), rng.randrange(1, 15), rng.randrange(1, 34)
        return rng.choice([f"{y}-{m:02d}-{day:02d}", f"{day:02d}.{m:02d}.{y}", f"{m:02d}/{day:02d}/{y}"])
    if kind == "ip":
        return ".".join(str(rng.randrange(300 if rng.random() < 0.2 else 256)) for _ in range(4))
    if kind == "ssn":
        return f"{rng.choice(['000', '666', '9' + d(2), d(3), d(3), d(3)])}-{rng.choice(['00', d(2), d(2)])}-{d(4)}"
    if kind == "email":
        return f"{''.join(rng.choices('abcxyz', k=5))}.{d(2)}@{''.join(rng.choices('mnop', k=4))}.example.org"
    return f"+{rng.randrange(1, 9)} ({d(3)}) {d(3)}-{d(4)}" if kind == "phone" else f"api_key = {''.join(rng.choices('0123456789abcdef', k=32))}1"


VALID = {"card": lambda t: luhn(t) and len(set(t) - {" "}) > 1, "iban": mod97, "date": real_date, "ip": octets, "ssn": number, "email": lambda t: True, "phone": lambda t: True, "secret": lambda t: True}


@pytest.mark.parametrize("kind", pii.KINDS)
def test_values_of_every_kind(kind):
    rng, feistel = random.Random(kind), pii.Feistel(b"key")
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", re.sub("[0-9a-f]{33}", "hex", t))))
    new = {}
    for _ in range(400):
        value = drawn(rng, kind)
        for before, behind in (("see ", " for it"), ("(", ")"), ("", "")):
            text, counts = pii.pseudonymise(before + value + behind, feistel, {})
            assert text.startswith(before) and text.endswith(behind)
            got = text[len(before) : len(text) - len(behind)]
            if not VALID[kind](value):
                assert counts[pii.KINDS.index(kind)] == 0 and (got == value or sum(counts)), value
                continue
            assert sum(counts) == 1 and counts[pii.KINDS.index(kind)] == 1 and VALID[kind](got), (value, got)
            if kind != "ip":
                assert shape(got) == shape(value)
            assert new.setdefault(value, got) == got
    assert len(set(new.values())) == len(new) and sum(a != b for a, b in new.items()) >= 0.99 * len(new) > 50


def words_of(text):
    return re.findall(r"[^\W_]+", text.lower())


def test_notices_against_every_window(spark):
    """What is found holds its share of the template's shingles, and every stretch that holds it is found."""
    rng = random.Random(31)
    rows = [(n, t) for n, t in licenses.TEMPLATES] + [("Own-1.0", " ".join(f"own{rng.randrange(400)}" for _ in range(450)))]
    templates = licenses.from_table(spark.createDataFrame([*rows, rows[0], (None, "a b c d"), ("x", None), ("x", "a b")], "license string, text string"))
    assert set(templates) == set(rows)
    with pytest.raises(ValueError):
        licenses.from_table(spark.createDataFrame(rows, "license string, text string"), most=3)
    shingles = lambda ws: {tuple(ws[k : k + 3]) for k in range(len(ws) - 2)}
    texts = []
    for name, text in templates:
        ws = words_of(text)
        for share in (0, 0.03, 0.1, 0.4):
            changed = [w if rng.random() >= share else f"other{rng.randrange(99)}" for w in ws]
            texts.append(" ".join([f"f{rng.randrange(999)}" for _ in range(rng.randrange(60))] + changed + [f"g{rng.randrange(999)}" for _ in range(rng.randrange(60))]))
    found = licenses.Templates(templates).scan(pa.array(texts))
    pieces = [(k, words_of(p)) for k, (_, t) in enumerate(templates) for p in licenses.Templates._cut(t, 3 * licenses.SIZES[-1] // 4)]
    for text, k, first, n, share in found:
        held = shingles(words_of(texts[text])[first : first + n])
        assert any(o == k and abs(len(held & shingles(p)) / len(shingles(p)) - share) < 1e-9 for o, p in pieces) and share >= licenses.CONTAINED
    spans = {}
    for text, _, first, n, _ in found:
        spans.setdefault(text, []).append((first, first + n))
    for text, ws in enumerate(map(words_of, texts)):
        for k, piece in pieces:
            want, size = shingles(piece), len(piece)
            needed = {(a.lower(), b.lower()) for a, b in licenses.telling(templates[k][0], " ".join(piece))}
            for at in range(max(1, len(ws) - size + 1)):
                part = ws[at : at + size]
                if len(shingles(part) & want) >= licenses.CONTAINED * len(want) and needed <= set(zip(part, part[1:])):
                    assert any(a < at + size and at < b for a, b in spans.get(text, ())), (templates[k], ws[at : at + size])
