import pytest

from millrace.sources import auth


def test_headers():
    assert auth.headers("bearer", token="t") == {"Authorization": "Bearer t"}
    assert auth.headers("basic", user="a", password="b") == {"Authorization": "Basic YTpi"}
    assert auth.headers("api_key", value="k") == {"X-API-Key": "k"} and auth.headers("none") == {}
    with pytest.raises(ValueError):
        auth.headers("magic")


def test_tokens_are_refreshed_once(tmp_path):
    store = auth.FileTokens(str(tmp_path / "t.json"))
    assert store.get("x") is None
    store.put("x", auth.Tokens("old", "r", 100.0))
    asked = []
    o = auth.OAuth2("x", store, lambda t: asked.append(t.refresh) or auth.Tokens("new", "r2", 900.0), clock=lambda: 0.0)
    assert o() == "old" and o(refused=True) == "new" and o() == "new" and asked == ["r"]
    late = auth.OAuth2("x", store, lambda t: auth.Tokens("newer"), clock=lambda: 899.0)
    assert late() == "newer" and auth.FileTokens(str(tmp_path / "t.json")).get("x").access == "newer"
    (tmp_path / "t.json").write_text("nope")
    assert store.get("x") is None
    with pytest.raises(LookupError):
        auth.OAuth2("y", auth.MemoryTokens(), lambda t: t)()


def test_environment():
    env = {"A": "1", "B": ""}
    assert auth.from_environment("$A ${A} ${B:-x} ${C:-y} $C!", env) == "1 1 x y !"
