import duckdb
from conftest import SCHEMA
from leafmill.llm import chat, licenses
from leafmill.llm import queries as q


def test_rotation(spark):
    rows = [(1, 0, "system", "rules", 0), (1, 2, "bo", "hi <|end|>", 0), (1, 1, "al", None, 0), (1, 3, "al", "bye", 0), (2, None, None, "x", 0), (None, 0, "system", "only", 0)]
    found = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")).collect()
    by = {(r.conv_id, r.speaker): r for r in found}
    assert set(by) == {(1, "al"), (1, "bo"), (2, "unknown")}
    r = by[1, "bo"]
    assert r.rendered == "<|system|>\nrules<|end|>\n<|user:al|>\n<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user:al|>\nbye<|end|>\n"
    spans = [tuple(map(int, s.split("-"))) for s in by[1, "al"].mask_spans.split(",")]
    assert [by[1, "al"].rendered[a:b] for a, b in spans] == ["<|end|>\n", "bye<|end|>\n"]


def test_long_conversation_is_cut_into_parts(spark):
    df = spark.range(1300).selectExpr("7 AS conv_id", "id AS turn", "concat('r', id % 3) AS role", "'t' AS text")
    rows = chat.rotate(df).collect()
    assert sorted((r.part, r.speaker) for r in rows) == [(p, f"r{s}") for p in range(3) for s in range(3)]
    assert sum(r.n_trained for r in rows) == 1300


def test_parts_hold_the_whole_conversation(spark):
    turns = [(7, 0, "system", "rules"), (7, 1, "early", "hello")] + [(7, i, "al" if i % 2 else "bo", f"t{i:03}") for i in range(2, 600)] + [(7, 600, "late", "bye"), (7, 601, "system", "more")]
    ties = [(None, None, "al", f"n{i:04}") for i in range(1100)] + [(8, 0, "system", "alone")]
    found = chat.rotate(spark.createDataFrame(turns + ties, "conv_id long, turn long, role string, text string"), part_turns=256).collect()
    by = {(r.conv_id, r.part, r.speaker): r for r in found}
    assert set(by) == {(7, p, s) for p in range(3) for s in ("early", "al", "bo", "late")} | {(None, p, "al") for p in range(5)}
    for speaker in ("early", "al", "bo", "late"):
        text = ["<|system|>\nrules<|end|>\n"] + [f"<|{'assistant' if s == speaker else 'system' if s == 'system' else 'user:' + s}|>\n{t}<|end|>\n" for _, _, s, t in turns[1:]]
        assert "".join(by[7, p, speaker].rendered for p in range(3)) == "".join(text)
        for p in range(3):
            r = by[7, p, speaker]
            assert r.context == (text[0] if p else "") and r.rendered == "".join(text[256 * p : 256 * (p + 1)]) and r.n_turns == len(text[256 * p : 256 * (p + 1)])
            spans = [tuple(map(int, s.split("-"))) for s in r.mask_spans.split(",") if s]
            assert len(spans) == r.n_trained and all(r.rendered[:a].endswith("<|assistant|>\n") for a, _ in spans)
    assert [by[None, p, "al"].n_turns for p in range(5)] == [256, 256, 256, 256, 76]


def test_long_conversations_equal_sql(spark):
    turns = [(7, i, "system" if i % 250 == 9 else "late" if i > 1000 else f"s{i % 3}", f"t{i % 40}") for i in range(1100)] + [(None, i // 7, "al", f"n{i}") for i in range(600)] + [(3, None, None, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    found = chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({q.OP1_SQL})").fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want)) and len(want) == 3 * 4 + 2 + 1


def test_rotation_of_repeats_and_nothing(spark):
    df = spark.createDataFrame([(1, 0, "a", "x")] * 2, "conv_id long, turn long, role string, text string")
    assert [r.n_turns for r in chat.rotate(df).collect()] == [2]
    assert chat.rotate(df.limit(0)).count() == 0


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    texts = [mit, None, "", "Foo.\nLicensed under the Apache License, Version 2.0. Bar\nReleased under the MIT License.", "you may obtain a copy of the License at home", "plain text", "Licensed under CC BY-NC 4.0.\n" * 3, "x " * 200_000 + "\nSPDX-License-Identifier: MIT"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).selectExpr("*", "1 AS ids", "2 AS left_0")
    found = {r.doc_id: (r.sentence_ids, r.licences) for r in licenses.scan(df).collect()}
    assert found[0] == ("MIT_GRANT MIT_NOTICE MIT_ASIS", "MIT") and found[1] == found[2] == found[5] == ("", "")
    assert found[3] == ("APACHE2_LINE MIT_LINE", "Apache-2.0,MIT") and found[4] == ("APACHE2_COPY", "UNMATCHED")
    assert found[6] == ("CC_BY_NC CC_BY_NC CC_BY_NC", "CC-BY-NC-4.0") and found[7] == ("SPDX_MIT", "MIT")
    assert licenses.scan(df.limit(0)).count() == 0


WRAPPED = {
    "MIT": """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of Google Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
""",
    "Apache-2.0": """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
""",
    "GPL-2.0": """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
""",
    "GPL-3.0": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
""",
    "BSD-2-Clause": """Copyright (c) 2012, The Authors
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

(1) Redistributions of source code must retain the above copyright
    notice, this list of conditions and the following disclaimer.
(2) Redistributions in binary form must reproduce the above copyright
    notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE AUTHOR AND CONTRIBUTORS ``AS IS'' AND
ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
""",
    "ISC": """Copyright (c) 2004 Some One <one@example.org>

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES.
""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
""",
    "AGPL-3.0": """Foo is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.

Foo is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
""",
}


def test_mentions_do_not_count(spark):
    texts = [
        "He compared it with the GNU Affero General Public License in a talk.", "The MIT License is short, and the Apache License, Version 2.0 is not.", "They argued that all rights reserved is an empty phrase.",
        "We ask whether it is licensed under the MIT License.", "Nobody offers permission to use, copy or sell this.", "A warranty: this software is provided by us.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.licences for r in licenses.scan(df).collect()} == {""}


def test_notices_of_one_line_each(spark):
    rows = [
        ("MIT", "no full stop before\n// This file is released under the terms of the MIT license"), ("Apache-2.0", "x***\n# Licensed to the ASF.\n# The ASF licenses this file to You under the Apache License, Version 2.0 (the"),
        ("Apache-2.0,MIT", "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */ int x;"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"), ("Proprietary", "Copyright 2020 Foo Inc. All rights reserved."),
        ("LGPL-2.1", "; SPDX-License-Identifier: LGPL-2.1-only WITH x"), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), ("", "MIT"),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in licenses.scan(df).collect()} == {i: name for i, (name, _) in enumerate(rows)}


def test_more_licences_and_full_texts(spark):
    rows = [
        ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE"),
        ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc."), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nx"),
        ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin"),
        ("BSL-1.0", "// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file)"), ("BSL-1.0", "SPDX-License-Identifier: BSL-1.0"), ("", "SPDX-License-Identifier: BSL-1.1"),
        ("EPL-2.0", " * This program and the accompanying materials are made\n * available under the terms of the Eclipse Public License 2.0\n * which is available at https://www.eclipse.org/legal/epl-2.0/"),
        ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."), ("GPL-2.0 WITH Classpath-exception-2.0", "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0"),
        ("UNMATCHED", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software for evaluation only and never for production."),
        ("UNMATCHED", "Released under the MIT license for non-commercial purposes."), ("", "The GNU General Public License version 3, 29 June 2007, is long."),
        ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the\nGNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r.licences for r in licenses.scan(df).collect()}
    assert found == {i: name for i, (name, _) in enumerate(rows)}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (_, t) in enumerate(rows)])
    assert dict(con.execute(f"SELECT doc_id, licences FROM ({licenses.oracle_sql()})").fetchall()) == found


def test_wrapped_standard_licences(spark):
    as_comment = {name: "".join(f" * {line}".rstrip() + "\r\n" for line in text.splitlines()) for name, text in WRAPPED.items()}
    marked = [{name: "import x\n" + "".join(f"{mark} {line}".rstrip() + "\n" for line in text.splitlines()) + "x = 1" for name, text in WRAPPED.items()} for mark in ("#", "//", "--")]
    rows = [(name, form) for forms in (WRAPPED, as_comment, *marked) for name, form in forms.items()] + [(n, " ".join(WRAPPED[n].split())) for n in ("GPL-2.0", "ISC", "MPL-2.0", "MIT")]
    df = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in licenses.scan(df).collect()} == {i: name for i, (name, _) in enumerate(rows)}
    lines = "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0\nno licence here\n\nPermission is hereby granted, free of charge,\n\nto any person obtaining a copy of this software"
    (r,) = licenses.scan(spark.createDataFrame([(1, lines)], "doc_id long, text string")).collect()
    assert (r.sentence_ids, r.licences) == ("SPDX_MIT SPDX_APACHE2", "Apache-2.0,MIT")


def test_no_python_in_native_plans(spark, sf):
    for f in (q.op1_chat, q.op8_licenses):
        plan = f(spark, sf)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_sql_twins(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    con.execute("CREATE TABLE wrapped AS SELECT unnest(?::VARCHAR[]) AS text", [[*WRAPPED.values(), "/* SPDX-License-Identifier: (MIT OR ISC) */ int x;", "all rights reserved, it says.\n-- This file is available under the ISC license", "Copyright 2020 Foo Inc. All rights reserved.", " ".join(WRAPPED["MIT"].split())]])
    forms = con.execute("SELECT row_number() OVER () AS doc_id, text FROM wrapped").df()
    want = con.execute(licenses.oracle_sql().replace("FROM documents", "FROM forms")).df()
    found = licenses.scan(spark.createDataFrame(forms))
    assert sorted(map(tuple, found.toPandas().values)) == sorted(map(tuple, want[found.columns].values))
    for name, sql in q.oracle_sql().items():
        df = q.queries()[name](spark, sf)
        want = con.execute(sql).df()[df.columns]
        assert sorted(map(str, map(tuple, df.toPandas().astype(str).values))) == sorted(map(str, map(tuple, want.astype(str).values))), name
