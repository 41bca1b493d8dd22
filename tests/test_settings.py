"""Settings from a file and the environment."""

import pytest

from docweave import settings as s

WHOLE = {s.KEY: "abcdefgh", s.ENDPOINT: "http://x/v1"}


def test_defaults(tmp_path):
    found = s.Settings.load(f"{tmp_path}/none", WHOLE)
    assert (found.key, found.base_url, found.model, found.timeout, found.requests) == ("abcdefgh", "http://x/v1", s.DEFAULT_MODEL, 300, 5)
    service = found.service()
    assert (service.base_url, service.key, service.tasks, service.timeout) == ("http://x/v1", "abcdefgh", 5, 300)


def test_the_file_goes_over_the_environment(tmp_path):
    (tmp_path / "env").write_text(f"# settings\n\nexport {s.MODEL} = \"a \\\"b\\\"\" # the model\n{s.TIMEOUT}=20 # seconds\n{s.KEY}='k # y'\nnot a line\n{s.REQUESTS}=\n")
    found = s.Settings.load(f"{tmp_path}/env", {**WHOLE, s.TIMEOUT: "9", s.REQUESTS: "7"})
    assert (found.key, found.model, found.timeout, found.requests) == ("k # y", 'a "b"', 20, 5)


@pytest.mark.parametrize("text, value", [(None, 5), ("", 5), ("0", 5), ("-1", 5), ("x", 5), ("2.5", 5), (" 8 ", 8), ("1_0", 10)])
def test_numbers(tmp_path, text, value):
    assert s.Settings.load(f"{tmp_path}/none", {**WHOLE, **({s.REQUESTS: text} if text is not None else {})}).requests == value


@pytest.mark.parametrize("gone", [s.KEY, s.ENDPOINT])
def test_what_has_to_be_there(tmp_path, gone):
    for environment in ({k: v for k, v in WHOLE.items() if k != gone}, {**WHOLE, gone: ""}):
        with pytest.raises(ValueError, match=gone):
            s.Settings.load(f"{tmp_path}/none", environment)


def test_the_key_is_not_shown():
    assert "abcd" not in repr(s.Settings("abcdefgh", "u")) and "efgh" in repr(s.Settings("abcdefgh", "u")) and "abc" not in repr(s.Settings("abc", "u"))
