"""Real licence texts and headers, with holders and line breaks of their own."""

import textwrap

from pyspark.sql import functions as F

from scribespark.llm import licenses

MIT = """The MIT License (MIT)

Copyright (c) 2014 Jane Roe and others

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
BSD = """Copyright 2009 The Regents of Somewhere. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
   * Neither the name of Somewhere nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED."""
GPL3 = """# tool.py - does things
# Copyright (C) 2011 Somebody
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
APACHE = """/*
 * Copyright 2020 Somebody
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */"""
CODE = "\n".join(f"def f{i}(x):\n    return x + {i} * compute(x, table[{i}])\n" for i in range(150))
PROSE = " ".join(f"ordinary words about place {i} and the people of town {i % 7} who live there" for i in range(12))


def whole(name):
    return textwrap.fill(" ".join(licenses.WHOLE[name][0].split()), 60)


def test_real_licences(spark):
    files = {"m/LICENSE": MIT, "b/COPYING": BSD, "a/LICENSE": whole("Apache-2.0") + "\n\nCopyright 2020 Somebody", "g/COPYING": whole("GPL-3.0"), "h/COPYING": whole("GPL-2.0")}
    headed = {
        "x/gpl.py": GPL3 + "\n\n" + CODE,
        "x/apache.java": APACHE + "\n" + CODE,
        "x/mit.c": "\n".join(f"// {x}".rstrip() for x in MIT.split("\n")) + "\n" + CODE,
        "x/mid.c": CODE + "\n\n" + MIT + "\n\n" + CODE,
        "x/one.go": "// Copyright 2020 John. Use of this source code is governed by the MIT license that can be found in the LICENSE file.\n" + CODE,
        "x/spdx.rs": "// SPDX-License-Identifier: Apache-2.0\n" + CODE,
    }
    below = {f"{d}/src/x": PROSE for d in "mbagh"}
    plain = {f"p{i}/x": f"{PROSE} {i}" for i in range(200)} | {"q/x": "A driving license costs money; the copyright of songs is another matter.\n" + PROSE}
    rows = [(i, p, t) for i, (p, t) in enumerate((files | headed | below | plain).items())]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.path: (r.license, r.origin) for r in licenses.scan(df, F.col("path")).collect()}
    names = {"m": "MIT", "b": "BSD-3-Clause", "a": "Apache-2.0", "g": "GPL-3.0", "h": "GPL-2.0"}
    assert {p: got[p] for p in files} == {p: (names[p[0]], "own") for p in files}
    assert {p: got[p] for p in below} == {p: (names[p[0]], "inherited") for p in below}
    want = {"x/gpl.py": "GPL-3.0", "x/apache.java": "Apache-2.0", "x/mit.c": "MIT", "x/mid.c": "MIT", "x/one.go": "MIT", "x/spdx.rs": "Apache-2.0"}
    assert {p: got[p] for p in headed} == {p: (n, "own") for p, n in want.items()}
    assert {got[p] for p in plain} == {(None, None)}


def test_words_count_over_all_documents(spark):
    rows = [(1, "the MIT license"), (2, "the cat"), (3, None), (4, "x-y the.end, the")]
    counts = licenses.frequencies(spark.createDataFrame(rows, "doc_id long, text string"), "text")
    assert {r.word: r.n for r in counts.collect()} == {"the": 3, "mit": 1, "license": 1, "cat": 1, "x-y": 1, "the.end": 1}
