import pytest

from cleanlake.operators.policy import LimitRule, Policy, ReplaceRule, clean_attribute, dump_default, load_policy, seconds


@pytest.mark.parametrize(
    "value, rule",
    [
        ("warn", ReplaceRule("warn", "#")), ("error", ReplaceRule("error", None)), (True, ReplaceRule("warn", "#")), (False, ReplaceRule("warn", None)), ("other", ReplaceRule("warn", "other")),
        ({"replace": "x", "level": "info"}, ReplaceRule("info", "x")), ({"replace": True, "level": "trace"}, ReplaceRule("trace", "#")), ({"replace": False, "level": "error"}, ReplaceRule("error", None)), ({"level": "info"}, ReplaceRule("info", None)),
    ],
)
def test_replace_rule_forms(value, rule):
    assert ReplaceRule.parse(value, "#") == rule


@pytest.mark.parametrize("value, rule", [(7, LimitRule(7)), ("warn", LimitRule(5, "warn")), ([7, "info"], LimitRule(7, "info")), ({"value": 7, "level": "warn"}, LimitRule(7, "warn"))])
def test_limit_rule_forms(value, rule):
    assert LimitRule.parse(value, 5) == rule


def test_bad_rules():
    for bad in (3, {"other": 1}, {"level": "loud"}):
        with pytest.raises(ValueError):
            ReplaceRule.parse(bad, "#")
    with pytest.raises(ValueError):
        load_policy('[html]\nallow_origins = ["not a host"]')


def test_default_text_is_the_default():
    assert load_policy(dump_default()) == load_policy() == Policy()


def test_partial_policy():
    got = load_policy('[html]\nno_such_key = 1\nmeta_refresh = "a/b c"\n[urls]\nidn = "error"\ndangerous_domains = ["A.com", "bücher.de"]\n[connections]\nmax_redirects = [4, "warn"]\noverall_timeout = "1m 30s"\n[other]\nx = 1')
    assert got == Policy(meta_refresh=ReplaceRule("warn", "abc"), idn=ReplaceRule("error", None), denied=("a.com", "xn--bcher-kva.de"), max_redirects=LimitRule(4, "warn"), overall_timeout=90.0)


def test_helpers():
    assert seconds("1500ms") == 1.5 and clean_attribute(" a/b=c>\n") == "abc"
    with pytest.raises(ValueError):
        seconds("soon")
