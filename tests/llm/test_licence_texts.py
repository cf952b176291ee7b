"""Standard licence texts, unshortened, as they are wrapped in files and on one line each."""

from __future__ import annotations

import re

from answerscore.llm import licences

MIT = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice."""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at"""


def test_standard_texts(spark):
    want = {"MIT": MIT, "GPL-3.0": GPL3, "GPL-2.0": GPL3.replace(": you", "; you").replace("version 3", "version 2"), "BSD": BSD, "MPL-2.0": MPL, "Apache-2.0": APACHE}
    rows = [(licence, text) for licence, wrapped in want.items() for text in (wrapped, wrapped.replace("\n", "\r\n"), re.sub(r"(?<!\n)\n[ #*]*(?!\n)", " ", wrapped))]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = [(r["doc_id"], [x["licence"] for x in r["licences"]]) for r in licences.scan(docs).collect()]
    assert got == [(licence, [licence]) for licence, _ in rows]


def test_sentences_do_not_go_on_over_ends_and_blank_lines(spark):
    rows = [(1, "Released under\nthe MIT License"), (2, "Released under\n\nthe MIT License"), (3, "Released under.\nthe MIT License"), (4, "It was released under\nthe MIT License"), (5, " \nAll rights reserved.\nAll rights\nreserved")]
    got = {r["doc_id"]: [tuple(x) for x in r["sentences"]] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(0, "mit-notice")], 2: [], 3: [], 4: [], 5: [(1, "rights-reserved"), (2, "rights-reserved")]}
