"""What the docstring of the URL filter names is there."""

import re

from casequarry.llm import url_filter


def test_constants_named_in_the_docstring_exist():
    assert all(hasattr(url_filter, name) for name in re.findall(r"``([A-Z_]+)``", url_filter.__doc__))
