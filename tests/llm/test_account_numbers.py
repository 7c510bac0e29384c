"""Account numbers are found whatever follows them."""

import pytest

from casetrail.llm import pii


@pytest.mark.parametrize("number", ("DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00",
                                    "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"))
@pytest.mark.parametrize("after", ("", " Please", " BIC COBADEFF", " 10 items", " A B C D E F G H", ". Thanks", " and", " GB82 WEST"))
def test_what_follows_is_left(number, after):
    text = f"to {number}{after}"
    assert list(pii._ibans(text)) == [(3, 3 + len(number))]
    assert pii.masked(text, pii.find_spans(text)).startswith("to [IBAN]" + after[:2])


def test_two_numbers_and_wrong_ones():
    one, two = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    assert list(pii._ibans(f"{one} {two} X")) == [(0, 27), (28, 50)]
    assert list(pii._ibans("DE89370400440532013000A DE88370400440532013000 Please XGB82WEST12345698765432")) == []
    assert len(list(pii._ibans("AA00 " * 20_000))) >= 0
