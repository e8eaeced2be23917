"""Wordings of license notices, and the words that tell one license from its siblings."""

from __future__ import annotations

# Customary wordings of license notices under their SPDX names.
GNU = {"GPL": "General", "LGPL": "Lesser General", "AGPL": "Affero General"}
GNU_VERSIONS = [("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3")]
CREATIVE_COMMONS = {
    "BY": "Attribution",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-SA": "Attribution-ShareAlike",
}
SPDX_IDS = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0",
    "CC-BY-4.0", "CC-BY-SA-4.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
]
TAG = "SPDX-License-Identifier:"
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License."
    ),
    # The clause that both have; only the third clause decides.
    "BSD-2-Clause OR BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met:"
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files, to deal in the Software without restriction."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
for _kind, _name in CREATIVE_COMMONS.items():
    TEMPLATES[f"CC-{_kind}-4.0"] = f"Licensed under CC {_kind} 4.0."
    TEMPLATES[f"CC-{_kind}-4.0-long"] = f"This work is licensed under a Creative Commons {_name} 4.0 International License."
for _kind, _version in GNU_VERSIONS:
    _id = f"{_kind}-{_version}" if "." in _version else f"{_kind}-{_version}.0"
    TEMPLATES[_id] = f"This work is licensed under the GNU {GNU[_kind]} Public License, version {_version}."
    TEMPLATES[f"{_id}-plain"] = f"Licensed under the GNU {GNU[_kind]} Public License, version {_version}."
    TEMPLATES[f"{_id}-short"] = f"Licensed under the GNU {_kind}, version {_version}."
    TEMPLATES[f"{_id}-header"] = (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        f"GNU {GNU[_kind]} Public License as published by the Free Software Foundation, either version {_version} of the "
        "License, or (at your option) any later version."
    )
for _id in SPDX_IDS:
    TEMPLATES[f"{_id}-tag"] = f"{TAG} {_id}"

# Words that name a license or change which one is meant.
NAMING = frozenset(
    [
        "affero", "agpl", "apache", "attribution", "bsd", "cc", "clause", "commons", "creative", "exception", "gnu", "gpl",
        "isc", "lesser", "lgpl", "library", "mit", "modified", "mozilla", "mpl", "nc", "nd", "noderivatives",
        "noderivs", "noncommercial", "sa", "sharealike", "spdx", "style", "unlicense", "variant", "zlib",
    ]
)
# Words that turn the notice behind them around.
NEGATIONS = frozenset(["cannot", "isn't", "neither", "never", "no", "nor", "not", "wasn't", "weren't", "aren't"])
# Operators of license expressions; a tag in front of one names only a part.
OPERATORS = frozenset(["AND", "OR", "WITH"])
