"""Notices as they stand in files, written down by hand, with the labels that a reader would give."""

import pytest

from isospark.llm import licenses

NOTICES = """
SPDX-License-Identifier: MIT => mit
SPDX-License-Identifier: MIT-0 => mit-0
SPDX-License-Identifier: Apache-2.0 => apache-2
SPDX-License-Identifier: GPL-2.0-only => gpl-2
SPDX-License-Identifier: GPL-2.0-or-later => gpl-2
SPDX-License-Identifier: GPL-2.0+ => gpl-2
SPDX-License-Identifier: GPL-3.0-only => gpl-3
SPDX-License-Identifier: GPL-3.0-or-later => gpl-3
SPDX-License-Identifier: GPL-1.0-or-later => gpl-1
SPDX-License-Identifier: LGPL-2.0-only => lgpl-2
SPDX-License-Identifier: LGPL-2.1-only => lgpl-2.1
SPDX-License-Identifier: LGPL-2.1-or-later => lgpl-2.1
SPDX-License-Identifier: LGPL-3.0-or-later => lgpl-3
SPDX-License-Identifier: AGPL-3.0-only => agpl-3
SPDX-License-Identifier: AGPL-3.0-or-later => agpl-3
SPDX-License-Identifier: AGPL-1.0-only => agpl-1
SPDX-License-Identifier: BSD-1-Clause => bsd-1-clause
SPDX-License-Identifier: BSD-2-Clause => bsd-2-clause
SPDX-License-Identifier: BSD-3-Clause => bsd-3-clause
SPDX-License-Identifier: BSD-3-Clause-Clear => bsd-3-clause-clear
SPDX-License-Identifier: BSD-4-Clause => bsd-4-clause
SPDX-License-Identifier: 0BSD => 0bsd
SPDX-License-Identifier: ISC => isc
SPDX-License-Identifier: MPL-2.0 => mpl-2
SPDX-License-Identifier: EPL-2.0 => epl-2
SPDX-License-Identifier: CC0-1.0 => cc0-1
SPDX-License-Identifier: CC-BY-4.0 => cc-by
SPDX-License-Identifier: CC-BY-SA-4.0 => cc-by-sa
SPDX-License-Identifier: CC-BY-NC-4.0 => cc-by-nc
SPDX-License-Identifier: CC-BY-ND-4.0 => cc-by-nd
SPDX-License-Identifier: CC-BY-NC-SA-4.0 => cc-by-nc-sa
SPDX-License-Identifier: CC-BY-NC-ND-4.0 => cc-by-nc-nd
SPDX-License-Identifier: Unlicense => unlicense
SPDX-License-Identifier: Zlib => zlib
SPDX-License-Identifier: BSL-1.0 => boost-1
SPDX-License-Identifier: Artistic-2.0 => artistic-2
SPDX-License-Identifier: OFL-1.1 => ofl-1.1
SPDX-License-Identifier: WTFPL => wtfpl
GPL version 2 or later => gpl-2
GPL version 3 or later => gpl-3
GPL v2 => gpl-2
GPL v. 2 => gpl-2
GPLv2 => gpl-2
GPLv2+ => gpl-2
GPLv3 => gpl-3
GPLv3+ => gpl-3
GPL-3.0 => gpl-3
GPL 2.0 => gpl-2
GNU GPL => gpl
GNU GPL v2.0 => gpl-2
GNU GPL version 3 => gpl-3
GNU GPLv3 => gpl-3
GNU GPL 3.0 => gpl-3
License: GPL-3 => gpl-3
License: GPL-2+ => gpl-2
the GPL license => gpl
GNU Public License => gpl
GNU General Public License => gpl
GNU General Public License v3.0 => gpl-3
GNU General Public License v2.0 => gpl-2
GNU General Public License, version 2 => gpl-2
GNU General Public License (GPL) version 3 => gpl,gpl-3
GNU General Public License version 2 or any later version => gpl-2
GNU General Public License, Version 3, 29 June 2007 => gpl-3
GNU General Public Licence version 3 => gpl-3
version 2 of the GNU General Public License => gpl-2
version 3 of the GNU General Public License as published => gpl-3
under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. => gpl-2
under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. => gpl-3
under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License. => gpl-2
under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. => lgpl-2.1
under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. => lgpl-3
under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. => lgpl-2
under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. => agpl-3
LGPL => lgpl
LGPL-2.1 => lgpl-2.1
LGPL version 2.1 => lgpl-2.1
LGPLv2.1 => lgpl-2.1
LGPLv2.1+ => lgpl-2.1
LGPL v3 => lgpl-3
LGPLv3 => lgpl-3
GNU LGPL 3.0 => lgpl-3
GNU LGPL version 2.1 or later => lgpl-2.1
GNU Lesser General Public License => lgpl
GNU Lesser General Public License v2.1 => lgpl-2.1
GNU Lesser General Public License version 3 => lgpl-3
GNU Lesser GPL version 3 => lgpl-3
GNU Library General Public License version 2 => lgpl-2
AGPL version 3 => agpl-3
AGPLv3 => agpl-3
AGPL-3.0 => agpl-3
GNU AGPL v3 => agpl-3
GNU AGPLv3 or later => agpl-3
GNU Affero GPL v3 => agpl-3
GNU Affero General Public License => agpl
GNU Affero General Public License v3.0 => agpl-3
Affero General Public License version 1 => agpl-1
https://www.gnu.org/licenses/gpl-3.0.html => gpl-3
https://www.gnu.org/licenses/old-licenses/gpl-2.0.txt => gpl-2
https://www.gnu.org/licenses/old-licenses/lgpl-2.1.html => lgpl-2.1
https://www.gnu.org/licenses/lgpl-3.0.en.html => lgpl-3
https://www.gnu.org/licenses/agpl-3.0.html => agpl-3
http://www.apache.org/licenses/LICENSE-2.0 => apache-2
Licensed under the Apache License, Version 2.0 (the "License") => apache-2,unknown
Apache License 2.0 => apache-2
Apache 2.0 license => apache-2
Apache-2.0 => apache-2
Apache License => apache
Apache Software License, Version 1.1 => apache-1.1
Apache Software License => apache
ASL 2.0 => apache-2
MIT License => mit
The MIT License (MIT) => mit
license: mit => mit
license: mit-0 => mit-0
MIT-0 => mit-0
MIT No Attribution => mit-0
MIT licensed => mit
Released under the MIT license. => mit
https://opensource.org/licenses/MIT => mit
https://choosealicense.com/licenses/mit/ => mit
Permission is hereby granted, free of charge, to any person obtaining a copy of this software => mit
Expat license => mit
X11 License => x11
ISC License => isc
BSD license => bsd
BSD-style license => bsd
BSD 3-Clause License => bsd-3-clause
BSD-3-Clause => bsd-3-clause
3-clause BSD => bsd-3-clause
3-Clause BSD License => bsd-3-clause
three-clause BSD license => bsd-3-clause
New BSD License => bsd-3-clause
Modified BSD License => bsd-3-clause
revised BSD license => bsd-3-clause
BSD 2-Clause "Simplified" License => bsd-2-clause
2-clause BSD license => bsd-2-clause
two-clause BSD license => bsd-2-clause
Simplified BSD License => bsd-2-clause
FreeBSD License => bsd-2-clause
four-clause BSD license => bsd-4-clause
original BSD license => bsd-4-clause
BSD 4-clause => bsd-4-clause
The Clear BSD License => bsd-3-clause-clear
Zero-Clause BSD => 0bsd
Redistribution and use in source and binary forms, with or without modification, are permitted => bsd
Mozilla Public License 2.0 => mpl-2
Mozilla Public License, v. 2.0 => mpl-2
Mozilla Public License Version 1.1 => mpl-1.1
MPL 2.0 => mpl-2
Eclipse Public License - v 2.0 => epl-2
Eclipse Public License - v 1.0 => epl-1
Eclipse Public License => epl
Common Development and Distribution License => cddl
CDDL 1.1 => cddl-1.1
Microsoft Public License => ms-pl
Artistic License 2.0 => artistic-2
zlib License => zlib
zlib/libpng license => zlib
Boost Software License - Version 1.0 => boost-1
Business Source License 1.1 => busl-1.1
Server Side Public License => sspl-1
Elastic License 2.0 => elastic-2
This is free and unencumbered software released into the public domain. => unlicense
released into the public domain => public-domain
CC0 1.0 Universal => cc0-1
CC BY 4.0 => cc-by
CC-BY-SA 3.0 => cc-by-sa
CC BY-NC-SA 4.0 => cc-by-nc-sa
CC BY-NC-ND 4.0 => cc-by-nc-nd
CC BY-ND 2.0 => cc-by-nd
Creative Commons Attribution 4.0 International => cc-by
Creative Commons Attribution 4.0 International Public License => cc-by
Creative Commons Attribution-ShareAlike 3.0 Unported License => cc-by-sa
Creative Commons Attribution-NonCommercial 4.0 => cc-by-nc
Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International => cc-by-nc-sa
Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 => cc-by-nc-nd
Creative Commons BY-SA 4.0 => cc-by-sa
https://creativecommons.org/licenses/by/4.0/ => cc-by
https://creativecommons.org/licenses/by-nc-sa/3.0/ => cc-by-nc-sa
https://creativecommons.org/publicdomain/zero/1.0/ => cc0-1
a Creative Commons license => cc
SIL Open Font License 1.1 => ofl-1.1
Open Database License => odbl
GNU Free Documentation License, Version 1.3 => gfdl-1.3
European Union Public Licence v. 1.2 => eupl-1.2
EUPL v1.2 => eupl-1.2
PostgreSQL License => postgresql
Python Software Foundation License => python-2
All rights reserved. => proprietary
see the license for details => unknown
it is hard to license a permit for the general public => 
the lgplish word and a bsdlike one, mitigated => 
"""

CASES = [tuple(line.rsplit(" =>", 1)) for line in NOTICES.strip().split("\n")]
SCAN = licenses.Scanner().scan


def test_there_are_many():
    assert len({text for text, _ in CASES}) >= 150


@pytest.mark.parametrize(("text", "labels"), CASES)
def test_notice(text, labels):
    got = {m[2] for m in SCAN(f"/* {text} */".encode())[2]}
    assert ",".join(sorted(got)) == labels.strip()
