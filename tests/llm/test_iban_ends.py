"""IBANs of all lengths, in blocks and in one piece, before words of all lengths."""

import pytest

from tallyspark.llm import pii


@pytest.mark.parametrize("length", range(15, 35))
def test_words_after_ibans(length):
    f, body = pii.Feistel(b"k"), "".join(str(k * 7 % 10) for k in range(length - 4))
    iban = f"ES{98 - pii._mod97(body + 'ES00'):02d}{body}"
    blocks = " ".join(iban[k : k + 4] for k in range(0, length, 4))
    for shape in (iban, blocks):
        for tail in ("", ".", " a", " is", " for rent", " paid to them", " 12 March", " A1 and more"):
            new, counts = pii.pseudonymise(f"to {shape}{tail}", f, {})
            assert counts[pii.KINDS.index("iban")] == 1 and iban not in new.replace(" ", "")
            assert new.endswith(tail) and len(new) == len(f"to {shape}{tail}")


@pytest.mark.parametrize("tail", ["", " for rent", " 12 march"])
def test_lower_case_ibans_agree_with_upper_case_ones(tail):
    f, iban = pii.Feistel(b"k"), "DE89370400440532013000"
    blocks = " ".join(iban[k : k + 4] for k in range(0, 22, 4))
    for shape in (iban, blocks):
        upper, lower = (pii.pseudonymise(f"to {x}{tail}", f, {})[0] for x in (shape, shape.lower()))
        assert lower == f"to {upper[3 : 3 + len(shape)].lower()}{tail}" and shape.lower() not in lower
    assert "De89370400440532013000" in pii.pseudonymise("De89370400440532013000", f, {})[0]  # mixed case is no IBAN
