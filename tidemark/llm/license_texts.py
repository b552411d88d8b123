"""Licence notices by label, in their usual words, each with the phrases that must stand whole in it."""

from __future__ import annotations

from dataclasses import dataclass

_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""
_DISCLAIMER = """This software is provided by the copyright holders and contributors "as is" and any express or
implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a
particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any
direct, indirect, incidental, special, exemplary, or consequential damages."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} as
published by the Free Software Foundation, either version {version} of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You
should have received a copy of the {name} along with this program."""


@dataclass(frozen=True)
class Template:
    """A notice of licence `label`; all of `keys` are phrases of it that must be found whole."""

    label: str
    text: str
    keys: tuple[str, ...]


def _gnu(label: str, name: str, version: str) -> list[Template]:
    """The notice in a file's head, and the licence's name."""
    phrase = f"{name} version {version}"
    return [Template(label, _GNU.format(name=name, version=version), (f"{name} as published by", f"either version {version}")), Template(label, phrase, (phrase,))]


# The licences' notices.
TEMPLATES = [
    Template(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
        ("permission is hereby granted free of charge to any person obtaining a copy of this software",),
    ),
    Template("mit", "MIT License", ("mit license",)),
    Template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        ("permission to use copy modify and or distribute this software for any purpose with or without fee",),
    ),
    Template("isc", "ISC License", ("isc license",)),
    Template("bsd-2-clause", f"{_CONDITIONS} {_DISCLAIMER}", ("redistribution and use in source and binary forms", "distribution this software is provided")),
    Template(
        "bsd-3-clause",
        f"""{_CONDITIONS} Neither the name of the copyright holder nor the names of its contributors may be used to endorse
        or promote products derived from this software without specific prior written permission. {_DISCLAIMER}""",
        ("redistribution and use in source and binary forms", "endorse or promote products derived from this software"),
    ),
    Template("bsd-2-clause", "BSD 2-Clause License", ("bsd 2 clause license",)),
    Template("bsd-3-clause", "BSD 3-Clause License", ("bsd 3 clause license",)),
    Template(
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
        ("apache license version 2 0",),
    ),
    Template("apache-2", "Apache License, Version 2.0", ("apache license version 2",)),
    *_gnu("gpl-2", "GNU General Public License", "2"),
    *_gnu("gpl-3", "GNU General Public License", "3"),
    *_gnu("lgpl-2.1", "GNU Lesser General Public License", "2.1"),
    *_gnu("lgpl-3", "GNU Lesser General Public License", "3"),
    *_gnu("agpl-3", "GNU Affero General Public License", "3"),
    Template(
        "mpl-2",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        ("mozilla public license v 2 0",),
    ),
    Template("mpl-2", "Mozilla Public License, version 2.0", ("mozilla public license version 2",)),
    Template(
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means.""",
        ("free and unencumbered software released into the public domain",),
    ),
    Template(
        "zlib",
        """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
        alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not
        be misrepresented; you must not claim that you wrote the original software.""",
        ("permission is granted to anyone to use this software for any purpose",),
    ),
    Template(
        "bsl-1",
        """Boost Software License - Version 1.0. Permission is hereby granted, free of charge, to any person or organization
        obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
        reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works.""",
        ("any person or organization obtaining a copy of the software and accompanying documentation",),
    ),
    Template(
        "cc0",
        """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this
        work. CC0 1.0 Universal Public Domain Dedication.""",
        ("waived all copyright and related or neighboring rights",),
    ),
    Template("cc0", "CC0 1.0 Universal", ("cc0 1 0 universal",)),
    Template("cc-by", "Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
    Template("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0",)),
    Template("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
]
# The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
