"""License rules on whole notices, wrapped ones, and texts without any."""

from repograin.llm import licenses

MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
GPL = "// This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 3 of the License, or\n(at your option) any later version.\n"


def found(docs, rows):
    return sorted(((r.doc_id, r.license, r.rule) for r in licenses.scan(docs(rows)).collect()), key=str)


def test_notices(docs):
    rows = [
        (1, MIT), (2, "Words.\nReleased under the MIT License.\nMore words"), (3, "Licensed under CC BY-NC 4.0."), (4, "Licensed under the Apache License, Version 2.0. All rights reserved."),
        (5, GPL), (6, "This work is licensed under the GNU General Public Licence, version 3."), (7, "We talk about the MIT license here."), (8, None), (9, ""), (10, "word " * 200_000 + "\n" + "MIT License"),
        (11, "SPDX-License-Identifier: Apache-2.0"), (2, "Released under the MIT License."), (None, "Licensed under CC BY 4.0."),
    ]
    assert found(docs, rows) == sorted([
        (1, "MIT", 12), (2, "MIT", 15), (3, "CC-BY-NC-4.0", 23), (4, "Apache-2.0", 11), (4, "LicenseRef-all-rights-reserved", 31), (5, "GPL-3.0-or-later", 5),
        (6, "GPL-3.0-only", 7), (10, "MIT", 16), (11, "Apache-2.0", 26), (None, "CC-BY-4.0", 25)], key=str)


def test_rules_name_known_sentences():
    assert {i for _, ids in licenses.RULES for i in ids} == set(licenses.SENTENCES)


def test_earlier_rules_take_their_sentences(docs):
    text = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.\n" \
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n" \
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    endorse = "Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    assert found(docs, [(1, text), (2, text + endorse)]) == [(1, "BSD-2-Clause", 20), (2, "BSD-3-Clause", 18)]


def test_clashing_columns_and_empty_table(docs):
    from pyspark.sql import functions as F

    df = docs([(1, "MIT License")]).withColumn("license", F.lit(1)).withColumn("key", F.lit(2)).withColumn("rule", F.lit("x"))
    assert [tuple(r) for r in licenses.scan(df).collect()] == [(1, "MIT", 16, "mit_title")]
    assert licenses.scan(docs([])).collect() == []
