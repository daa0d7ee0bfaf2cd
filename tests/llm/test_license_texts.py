"""Standard notices and texts of public licences, worded as they are published."""

from compare import same
from test_corpus_operators import docs_of

from scriptorium.llm import licenses
from scriptorium.llm.queries import QUERIES
from scriptorium.llm.sql import ORACLE_SQL

BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}THIS SOFTWARE IS PROVIDED BY {whom} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
TEXTS = {
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1-notice": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "agpl-3.0-notice": "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl-2.0-notice": "are made available under the terms of the Eclipse Public License 2.0",
    "bsd-2-clause": BSD.format(third="", whom="THE COPYRIGHT HOLDERS AND CONTRIBUTORS"),
    "bsd-3-clause": BSD.format(third=THIRD, whom="the authors"),
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author of this work has waived all copyright and related or neighboring rights to it",
}


def test_notices(spark):
    rows = [(i, t, "a") for i, t in enumerate(TEXTS.values())]
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan_licenses(docs_of(spark, rows)).collect()}
    assert all(name in got[i] for i, name in enumerate(TEXTS))
    names = list(TEXTS)
    assert "bsd-3-clause" not in got[names.index("bsd-2-clause")] and "bsd-2-clause" not in got[names.index("bsd-3-clause")]
    altered = [(i, t.replace("terms", "words").replace("conditions", "rules").replace("law", "rule").replace("Commons", "Things"), "a") for i, t in enumerate(TEXTS.values())]
    lost = {r.doc_id: r.labels.split(",") for r in licenses.scan_licenses(docs_of(spark, altered)).collect()}
    assert not any(name in lost[i] for i, name in enumerate(TEXTS))


def test_texts_equal_sql(spark, tmp_path):
    rows = [(i, f"before {t} after", "a") for i, t in enumerate(TEXTS.values())] + [(99, None, "a")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    same(QUERIES["op9_license_scan"](spark, str(tmp_path)), ORACLE_SQL["op9_license_scan"], str(tmp_path), ("documents",))
