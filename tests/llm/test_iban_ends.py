"""A valid IBAN is found whatever token follows or precedes it, and comes back by the key."""

import pytest
from concordat.llm import pseudonym

KEY = b"0123456789abcdef"


@pytest.mark.parametrize(
    ("before", "value", "after"),
    [
        ("", "ES91 2100 0418 4502 0005 1332", " EUR"),
        ("to ", "BE68539007547034", " BIC"),
        ("", "AT611904300234573201", " 2024"),
        ("", "DE89370400440532013000", " EUROS AND 12 MORE"),
        ("REF AB12 3456 7890 ", "GB82 WEST 1234 5698 7654 32", " X"),
        ("", "NO9386011117947", ""),
    ],
)
def test_iban_beside_other_tokens(before, value, after):
    text = before + value + after
    new, found = pseudonym.pseudonymised(text, KEY)
    assert (len(before), len(before) + len(value), "iban") in [x[:3] for x in found]
    assert value not in new and pseudonym.pseudonymised(new, KEY, back=True)[0] == text


def test_two_ibans_in_a_row():
    new, found = pseudonym.pseudonymised("BE68539007547034 AT611904300234573201", KEY)
    assert [x[2] for x in found] == ["iban", "iban"] and pseudonym.pseudonymised(new, KEY, back=True)[0] == "BE68539007547034 AT611904300234573201"
