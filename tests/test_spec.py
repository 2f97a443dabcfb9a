from __future__ import annotations

import pytest

from ledgermatch.recon.spec import CheckSuite


def suite(**run):
    return {
        "data_checks": {
            "data_dir": "d",
            "view_list": ["a", "b"],
            "data_list": ["c"],
            "mapping_fields": {"a": {"STATUS": "status", "n": 1}, "b": "bad", 3: {"x": "y"}, "c": {}},
            "exclude_fields": {"a": ["x", 1], "b": "bad", 2: ["y"]},
        },
        "run_mode": run,
    }


def test_named_list_and_fallback():
    assert CheckSuite.from_config(suite(check_list="view_list")).datasets == ["a", "b"]
    assert CheckSuite.from_config(suite(check_list="unknown")).datasets == ["c"]
    for blank in (None, "", "  ", 5):
        chosen = CheckSuite.from_config(suite(check_list=blank))
        assert (chosen.check_list, chosen.datasets) == ("data_list", ["c"])


@pytest.mark.parametrize("lists", [{}, {"data_list": []}, {"data_list": "a"}])
def test_empty_list_is_an_error(lists):
    with pytest.raises(ValueError, match="missing or empty"):
        CheckSuite(lists=lists)


def test_options_of_a_dataset():
    checks = CheckSuite.from_config(suite(check_list="view_list", sample_diff_rows="7", debug="1"))
    assert checks.spec("a").mapping == {"STATUS": "status"}
    assert checks.spec("a").exclude == ("x",)
    assert checks.spec("b").mapping == {} and checks.spec("b").exclude == ()
    assert (checks.spec("a").sample_rows, checks.debug, checks.data_dir) == (7, 1, "d")


@pytest.mark.parametrize("value, expected", [(0, 5), (-3, 5), ("x", 5), (None, 5), ("2", 2)])
def test_sample_rows_fall_back(value, expected):
    assert CheckSuite(lists={"data_list": ["a"]}, sample_diff_rows=value).sample_diff_rows == expected


def test_ill_typed_options_are_left_out():
    checks = CheckSuite(lists={"data_list": ["a"]}, mapping_fields=[1], exclude_fields="x", debug="?")
    assert (checks.mapping_fields, checks.exclude_fields, checks.debug) == ({}, {}, 0)
