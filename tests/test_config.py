"""Settings as versioned snapshots."""

from __future__ import annotations

from dataclasses import replace

import pytest

from quaymetrics.sources.config import StaleSettings, oee_config_set, publish_settings, read_settings, settings_version


def _value(df, kind):
    return {r["bi_ov_value"] for r in df.where(f"bi_ov_value_type = '{kind}'").collect()}


def test_of_two_concurrent_updates_one_is_refused(spark, derived, tmp_path):
    root = str(tmp_path / "settings")
    assert settings_version(spark, root) == 0
    with pytest.raises(FileNotFoundError):
        read_settings(spark, root)
    assert publish_settings(derived.bi_oee_tml_value, root, 0) == 1
    mine, base = read_settings(spark, root)
    theirs, same = read_settings(spark, root)
    assert base == same == 1 and sorted(mine.collect()) == sorted(derived.bi_oee_tml_value.collect())
    assert publish_settings(oee_config_set(replace(derived, bi_oee_tml_value=mine), "SCH_DOWN", "70"), root, base) == 2
    with pytest.raises(StaleSettings):
        publish_settings(oee_config_set(replace(derived, bi_oee_tml_value=theirs), "TML_CLOSE", "5"), root, same)
    now, version = read_settings(spark, root)
    assert version == 2 and _value(now, "SCH_DOWN") == {"70"} and _value(now, "TML_CLOSE") == _value(mine, "TML_CLOSE")


def test_a_number_is_granted_once_even_after_the_first_look(spark, derived, tmp_path, monkeypatch):
    """Both have looked before either took the number."""
    root = str(tmp_path / "settings")
    publish_settings(derived.bi_oee_tml_value, root, 0)
    monkeypatch.setattr("quaymetrics.sources.config.settings_version", lambda spark, root: 1)
    assert publish_settings(derived.bi_oee_tml_value.limit(1), root, 1) == 2
    with pytest.raises(StaleSettings):
        publish_settings(derived.bi_oee_tml_value.limit(0), root, 1)
    monkeypatch.undo()
    assert read_settings(spark, root)[0].count() == 1
