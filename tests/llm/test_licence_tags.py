"""Identifier tags, long texts and exceptions of the licence scan."""

from __future__ import annotations

import time

import pytest

from tidemark.llm import licences


@pytest.mark.parametrize(
    "text, labels, score",
    [
        ("SPDX-License-Identifier: MIT.", "mit", 1.0),
        ("SPDX-License-Identifier: Apache-2.0.", "apache-2", 0.9),
        ("// SPDX-License-Identifier: GPL-2.0+, see COPYING", "gpl-2", 0.4),
        ("SPDX-License-Identifier: (MIT OR GPL-3.0-only).\nSPDX-License-Identifier:EPL-2.0", "epl,gpl-3,mit", 0.6),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "gpl-2", 0.5),
        ("SPDX-License-Identifier: GPL-2.0-only WITH my-own-exception", "gpl-2", 0.4),
        ("spdx license identifier: MIT", "", 0.0),  # the words, but not the tag
        ("SPDX-License-Identifier MIT", "", 0.0),
        ("SPDX-License-Identifier: (MIT OR", "", 0.0),
        ("SPDX-License-Identifier:", "", 0.0),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of", "mit", 1.0),
        ("available under CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa", 0.2),
    ],
)
def test_tags_and_notices(text, labels, score):
    found = licences.scan(text)
    assert found[5] == labels and found[6] == pytest.approx(score)


def test_places_in_a_text_of_ten_megabytes():
    times = 400_000
    start = time.monotonic()
    found = licences.scan("Under the MIT license, " * times + "SPDX-License-Identifier: MIT\n" * 1000)
    assert time.monotonic() - start < 30
    assert found[:4] == (4 * times + 4000, times, 0, 4 * (times - 1)) and found[5] == "mit"


def test_every_notice_has_a_value():
    assert set(licences.NOTICES.values()) | set(licences.BASE_PHRASES.values()) <= set(licences.PERMITS)
