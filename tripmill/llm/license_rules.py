"""The ordered signature rules of the license scan: hand-written, one a line, best first within a priority.

A line holds priority, label; keyword; words. In the words ``x?`` may be missing and ``(x|y)`` is a choice. The keyword is a word that
every text of the rule holds. Words are what the scan takes as words: lower case, without points and hyphens ("2.0" is ``2 0``).

Priorities: 1 identifiers and sentences of license texts, 2 grants that name a license, 3 names with a version, 4 names of a family,
5 notices without a license.
"""

#: Fixed values.
TEXT = """
1 mit; spdx; spdx license identifier mit
1 mit-0; spdx; spdx license identifier mit 0
1 apache-1.1; spdx; spdx license identifier apache 1 1
1 apache-2.0; spdx; spdx license identifier apache 2 0
1 apache-2.0-llvm; spdx; spdx license identifier apache 2 0 with llvm exception
1 bsd-1-clause; spdx; spdx license identifier bsd 1 clause
1 bsd-2-clause; spdx; spdx license identifier bsd 2 clause
1 bsd-2-clause-patent; spdx; spdx license identifier bsd 2 clause patent
1 bsd-3-clause; spdx; spdx license identifier bsd 3 clause
1 bsd-3-clause-clear; spdx; spdx license identifier bsd 3 clause clear
1 bsd-4-clause; spdx; spdx license identifier bsd 4 clause
1 0bsd; spdx; spdx license identifier 0bsd
1 isc; spdx; spdx license identifier isc
1 zlib; spdx; spdx license identifier zlib
1 libpng; spdx; spdx license identifier libpng 2? 0?
1 bsl-1.0; spdx; spdx license identifier bsl 1 0
1 busl-1.1; spdx; spdx license identifier busl 1 1
1 unlicense; spdx; spdx license identifier unlicense
1 wtfpl; spdx; spdx license identifier wtfpl
1 x11; spdx; spdx license identifier x11
1 ncsa; spdx; spdx license identifier ncsa
1 ntp; spdx; spdx license identifier ntp
1 psf-2.0; spdx; spdx license identifier psf 2 0
1 python-2.0; spdx; spdx license identifier python 2 0
1 postgresql; spdx; spdx license identifier postgresql
1 php-3.01; spdx; spdx license identifier php 3 01
1 ruby; spdx; spdx license identifier ruby
1 artistic-1.0; spdx; spdx license identifier artistic 1 0
1 artistic-2.0; spdx; spdx license identifier artistic 2 0
1 openssl; spdx; spdx license identifier openssl
1 curl; spdx; spdx license identifier curl
1 ecl-2.0; spdx; spdx license identifier ecl 2 0
1 afl-3.0; spdx; spdx license identifier afl 3 0
1 osl-3.0; spdx; spdx license identifier osl 3 0
1 upl-1.0; spdx; spdx license identifier upl 1 0
1 gpl-1.0-or-later; spdx; spdx license identifier gpl 1 0 or later
1 gpl-2.0-or-later; spdx; spdx license identifier gpl 2 0 or later
1 gpl-2.0-only; spdx; spdx license identifier gpl 2 0 only?
1 gpl-3.0-or-later; spdx; spdx license identifier gpl 3 0 or later
1 gpl-3.0-only; spdx; spdx license identifier gpl 3 0 only?
1 gpl-2.0; gplv2; spdx license identifier gplv2
1 gpl-3.0; gplv3; spdx license identifier gplv3
1 gpl-2.0-classpath; classpath; spdx license identifier gpl 2 0 only? or? later? with classpath exception 2 0
1 lgpl-2.0-or-later; spdx; spdx license identifier lgpl 2 0 or later
1 lgpl-2.1-or-later; spdx; spdx license identifier lgpl 2 1 or later
1 lgpl-2.1-only; spdx; spdx license identifier lgpl 2 1 only?
1 lgpl-3.0-or-later; spdx; spdx license identifier lgpl 3 0 or later
1 lgpl-3.0-only; spdx; spdx license identifier lgpl 3 0 only?
1 agpl-3.0-or-later; spdx; spdx license identifier agpl 3 0 or later
1 agpl-3.0-only; spdx; spdx license identifier agpl 3 0 only?
1 gfdl-1.3; spdx; spdx license identifier gfdl 1 3 or? later? only?
1 mpl-1.1; spdx; spdx license identifier mpl 1 1
1 mpl-2.0; spdx; spdx license identifier mpl 2 0
1 epl-1.0; spdx; spdx license identifier epl 1 0
1 epl-2.0; spdx; spdx license identifier epl 2 0
1 edl-1.0; spdx; spdx license identifier edl 1 0
1 cddl-1.0; spdx; spdx license identifier cddl 1 0
1 cddl-1.1; spdx; spdx license identifier cddl 1 1
1 cpl-1.0; spdx; spdx license identifier cpl 1 0
1 eupl-1.1; spdx; spdx license identifier eupl 1 1
1 eupl-1.2; spdx; spdx license identifier eupl 1 2
1 ms-pl; spdx; spdx license identifier ms pl
1 ms-rl; spdx; spdx license identifier ms rl
1 mulanpsl-2.0; spdx; spdx license identifier mulanpsl 2 0
1 ofl-1.1; spdx; spdx license identifier ofl 1 1
1 odbl-1.0; spdx; spdx license identifier odbl 1 0
1 pddl-1.0; spdx; spdx license identifier pddl 1 0
1 cdla-permissive-2.0; spdx; spdx license identifier cdla permissive 2 0
1 cdla-sharing-1.0; spdx; spdx license identifier cdla sharing 1 0
1 cc0-1.0; spdx; spdx license identifier cc0 1 0
1 cc-by-4.0; spdx; spdx license identifier cc by 4 0
1 cc-by-sa-4.0; spdx; spdx license identifier cc by sa 4 0
1 cc-by-nc-4.0; spdx; spdx license identifier cc by nc 4 0
1 cc-by-nd-4.0; spdx; spdx license identifier cc by nd 4 0
1 cc-by-nc-sa-4.0; spdx; spdx license identifier cc by nc sa 4 0
1 cc-by-nc-nd-4.0; spdx; spdx license identifier cc by nc nd 4 0
1 elastic-2.0; spdx; spdx license identifier elastic 2 0
1 sspl-1.0; spdx; spdx license identifier sspl 1 0
1 openrail; openrail; spdx license identifier (bigscience|creativeml)? openrail m?
1 other; licenseref; spdx license identifier licenseref
1 mit; hereby; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
1 mit; substantial; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
1 mit; noninfringement; warranties of merchantability fitness for a particular purpose and noninfringement
1 isc; hereby; permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted
1 0bsd; hereby; permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted the software is provided
1 bsd; redistribution; redistribution and use in source and binary forms with or without modification are permitted
1 bsd; redistributions; redistributions of source code must retain the above copyright notice
1 bsd; redistributions; redistributions in binary form must reproduce the above copyright notice
1 bsd-3-clause; endorse; nor the names of its contributors may be used to endorse or promote products
1 bsd-3-clause; endorse; may be used to endorse or promote products derived from this software without specific prior written permission
1 bsd-4-clause; advertising; all advertising materials mentioning features or use of this software must display the following acknowledgement
1 apache-2.0; apache; licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
1 apache-2.0; www; http www apache org licenses license 2 0
1 apache-2.0; www; https www apache org licenses license 2 0
1 apache-1.1; apache; this product includes software developed by the apache (software|group) foundation?
1 gpl-2.0-or-later; general; under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
1 gpl-3.0-or-later; general; under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
1 gpl-2.0-only; general; under the terms of the gnu general public license version 2 as published by the free software foundation
1 gpl-3.0-only; general; under the terms of the gnu general public license version 3 as published by the free software foundation
1 lgpl-2.1-or-later; lesser; under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
1 lgpl-3.0-or-later; lesser; under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
1 lgpl-2.0-or-later; library; under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
1 agpl-3.0-or-later; affero; under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
1 gpl; gnu; without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
1 lgpl; lesser; without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license
1 agpl-3.0; affero; without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license
1 gpl; gnu; you should have received a copy of the gnu general public license
1 lgpl; lesser; you should have received a copy of the gnu lesser general public license
1 agpl-3.0; affero; you should have received a copy of the gnu affero general public license
1 gfdl; documentation; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
1 mpl-2.0; mozilla; this source code form is subject to the terms of the mozilla public license v 2 0
1 mpl-2.0; mpl; if a copy of the mpl was not distributed with this file you can obtain one at
1 mpl-1.1; mozilla; the contents of this file are subject to the mozilla public license version 1 1
1 epl-1.0; eclipse; made available under the terms of the eclipse public license v1 0
1 epl-2.0; eclipse; made available under the terms of the eclipse public license (2|v2|v) 2? 0
1 cddl-1.0; distribution; the contents of this file are subject to the terms of the common development and distribution license
1 bsl-1.0; boost; distributed under the boost software license version 1 0
1 zlib; misrepresented; the origin of this software must not be misrepresented you must not claim that you wrote the original software
1 zlib; altered; altered source versions must be plainly marked as such
1 unlicense; unencumbered; this is free and unencumbered software released into the public domain
1 wtfpl; fuck; you just do what the fuck you want to
1 cc0-1.0; dedicated; the person who associated a work with this deed has dedicated the work to the public domain
1 cc0-1.0; waived; to the extent possible under law the authors? (has|have) waived all copyright and related or neighboring rights
1 openssl; openssl; this product includes software developed by the openssl project
1 ofl-1.1; sil; this font software is licensed under the sil open font license version 1 1
1 psf-2.0; psf; psf is making python available to licensee on an as is basis
1 ncsa; developed; developed by university of illinois
1 cc-by-4.0; creativecommons; creativecommons org licenses by 4 0
1 cc-by-3.0; creativecommons; creativecommons org licenses by 3 0
1 cc-by-2.0; creativecommons; creativecommons org licenses by 2 0
1 cc-by-sa-4.0; creativecommons; creativecommons org licenses by sa 4 0
1 cc-by-sa-3.0; creativecommons; creativecommons org licenses by sa 3 0
1 cc-by-nc-4.0; creativecommons; creativecommons org licenses by nc 4 0
1 cc-by-nd-4.0; creativecommons; creativecommons org licenses by nd 4 0
1 cc-by-nc-sa-4.0; creativecommons; creativecommons org licenses by nc sa 4 0
1 cc-by-nc-nd-4.0; creativecommons; creativecommons org licenses by nc nd 4 0
1 cc0-1.0; creativecommons; creativecommons org publicdomain zero 1 0
1 public-domain; creativecommons; creativecommons org publicdomain mark 1 0
1 gpl; gnu; www gnu org licenses gpl
1 lgpl; gnu; www gnu org licenses lgpl
1 agpl-3.0; gnu; www gnu org licenses agpl
1 mit; opensource; opensource org licenses mit
1 bsd-3-clause; opensource; opensource org licenses bsd 3 clause
1 mpl-2.0; mozilla; mozilla org mpl 2 0
2 apache-2.0; apache; (licensed|released|distributed|available|published|provided) under the? terms? of? the? apache software? license? version? (2|v2) 0?
2 apache; apache; (licensed|released|distributed|available|published|provided) under the? terms? of? the? apache license?
2 mit-0; mit; (licensed|released|distributed|available|published|provided) under the? terms? of? the? mit no attribution license?
2 mit; mit; (licensed|released|distributed|available|published|provided) under the? terms? of? the? mit license?
2 mit; expat; (licensed|released|distributed|available|published|provided) under the? terms? of? the? expat license?
2 isc; isc; (licensed|released|distributed|available|published|provided) under the? terms? of? the? isc license?
2 bsd-2-clause; bsd; (licensed|released|distributed|available|published|provided) under the? terms? of? the? (2|two|simplified) clause? bsd license?
2 bsd-3-clause; bsd; (licensed|released|distributed|available|published|provided) under the? terms? of? the? (3|three|new|modified|revised) clause? bsd license?
2 bsd; bsd; (licensed|released|distributed|available|published|provided) under the? terms? of? (a|the)? bsd style? license?
2 gpl-2.0; gpl; (licensed|released|distributed|available|published|provided) under the? terms? of? the? gnu? gpl version? (2|v2) 0?
2 gpl-3.0; gpl; (licensed|released|distributed|available|published|provided) under the? terms? of? the? gnu? gpl version? (3|v3) 0?
2 gpl-2.0; gplv2; (licensed|released|distributed|available|published|provided) under the? terms? of? the? gplv2
2 gpl-3.0; gplv3; (licensed|released|distributed|available|published|provided) under the? terms? of? the? gplv3
2 gpl; gpl; (licensed|released|distributed|available|published|provided) under the? terms? of? the? gnu? gpl
2 gpl-2.0; general; (licensed|released|distributed|available|published|provided) under the? terms? of? the? gnu? general public license version? (2|v2) 0?
2 gpl-3.0; general; (licensed|released|distributed|available|published|provided) under the? terms? of? the? gnu? general public license version? (3|v3) 0?
2 gpl; general; (licensed|released|distributed|available|published|provided) under the? terms? of? the? gnu? general public license
2 lgpl-2.1; lgpl; (licensed|released|distributed|available|published|provided) under the? terms? of? the? gnu? lgpl version? (2|v2) 1
2 lgpl-3.0; lgpl; (licensed|released|distributed|available|published|provided) under the? terms? of? the? gnu? lgpl version? (3|v3) 0?
2 lgpl; lgpl; (licensed|released|distributed|available|published|provided) under the? terms? of? the? gnu? lgpl
2 lgpl; lesser; (licensed|released|distributed|available|published|provided) under the? terms? of? the? gnu? lesser general public license
2 agpl-3.0; agpl; (licensed|released|distributed|available|published|provided) under the? terms? of? the? gnu? agpl version? v3? 3? 0?
2 agpl-3.0; affero; (licensed|released|distributed|available|published|provided) under the? terms? of? the? gnu? affero general public license version? v3? 3? 0?
2 mpl-2.0; mpl; (licensed|released|distributed|available|published|provided) under the? terms? of? the? mpl version? (2|v2) 0?
2 mpl-2.0; mozilla; (licensed|released|distributed|available|published|provided) under the? terms? of? the? mozilla public license version? (2|v2) 0?
2 epl-2.0; epl; (licensed|released|distributed|available|published|provided) under the? terms? of? the? epl version? (2|v2) 0?
2 epl; eclipse; (licensed|released|distributed|available|published|provided) under the? terms? of? the? eclipse public license
2 cc0-1.0; cc0; (licensed|released|distributed|available|published|provided|dedicated) under the? terms? of? the? creative? commons? cc0 1? 0?
2 cc-by-sa; cc; (licensed|released|distributed|available|published|provided) under a? the? terms? of? the? creative? commons? cc by sa
2 cc-by-nc; cc; (licensed|released|distributed|available|published|provided) under a? the? terms? of? the? creative? commons? cc by nc
2 cc-by-nd; cc; (licensed|released|distributed|available|published|provided) under a? the? terms? of? the? creative? commons? cc by nd
2 cc-by; cc; (licensed|released|distributed|available|published|provided) under a? the? terms? of? the? cc by
2 cc-by-sa; commons; (licensed|released|distributed|available|published|provided) under a? the? terms? of? the? creative commons attribution share? (alike|sharealike)
2 cc-by-nc; commons; (licensed|released|distributed|available|published|provided) under a? the? terms? of? the? creative commons attribution non? (commercial|noncommercial)
2 cc-by-nd; commons; (licensed|released|distributed|available|published|provided) under a? the? terms? of? the? creative commons attribution no? (derivatives|derivs|noderivatives|noderivs)
2 cc-by; commons; (licensed|released|distributed|available|published|provided) under a? the? terms? of? the? creative commons attribution
2 creative-commons; commons; (licensed|released|distributed|available|published|provided) under a? the? terms? of? (a|the)? creative commons license?
2 unlicense; unlicense; (licensed|released|distributed|available|published|provided) under the? terms? of? the? unlicense
2 wtfpl; wtfpl; (licensed|released|distributed|available|published|provided) under the? terms? of? the? wtfpl
2 zlib; zlib; (licensed|released|distributed|available|published|provided) under the? terms? of? the? zlib license?
2 bsl-1.0; boost; (licensed|released|distributed|available|published|provided) under the? terms? of? the? boost software? license
2 ofl-1.1; ofl; (licensed|released|distributed|available|published|provided) under the? terms? of? the? sil? ofl version? 1? 1?
2 odbl-1.0; odbl; (licensed|released|distributed|available|published|provided) under the? terms? of? the? odbl version? 1? 0?
2 public-domain; domain; (released|dedicated|placed|put) (into|to|in) the public domain
2 dual; dual; dual licensed under
2 python; python; (licensed|released|distributed|available|published|provided) under the? terms? of? the? python license
2 perl; perl; under the same terms as perl itself?
2 proprietary; proprietary; (licensed|released|distributed|available|published|provided) under a? the? terms? of? a? proprietary license
2 commercial; commercial; (licensed|released|distributed|available|published|provided) under a? the? terms? of? a? commercial license
3 apache-1.1; apache; apache software? license version? 1 1
3 apache-2.0; apache; apache software? license version? (2|v2) 0?
3 apache-2.0; apache; apache (2|v2) 0? license
3 bsd-2-clause; bsd; (2|two|simplified) clause? bsd license?
3 bsd-2-clause; bsd; bsd (2|two) clause license?
3 bsd-3-clause; bsd; (3|three|new|modified|revised) clause? bsd license?
3 bsd-3-clause; bsd; bsd (3|three) clause license?
3 bsd-4-clause; bsd; (4|four|original) clause? bsd license
3 bsd-4-clause; bsd; bsd (4|four) clause license?
3 0bsd; 0bsd; 0bsd license?
3 0bsd; zero; zero clause bsd license?
3 gpl-1.0; general; gnu? general public license version? (1|v1) 0?
3 gpl-2.0; general; gnu? general public license version? (2|v2) 0?
3 gpl-3.0; general; gnu? general public license version? (3|v3) 0?
3 gpl-2.0-or-later; gpl; gnu? gpl version? (2|v2) 0? or later
3 gpl-3.0-or-later; gpl; gnu? gpl version? (3|v3) 0? or later
3 gpl-2.0; gpl; gnu? gpl version? (2|v2) 0?
3 gpl-3.0; gpl; gnu? gpl version? (3|v3) 0?
3 gpl-2.0; gplv2; gplv2
3 gpl-3.0; gplv3; gplv3
3 lgpl-2.0; library; gnu? library general public license version? (2|v2) 0?
3 lgpl-2.1; lesser; gnu? lesser general public license version? (2|v2) 1
3 lgpl-3.0; lesser; gnu? lesser general public license version? (3|v3) 0?
3 lgpl-2.1; lgpl; gnu? lgpl version? (2|v2) 1
3 lgpl-3.0; lgpl; gnu? lgpl version? (3|v3) 0?
3 lgpl-2.1; lgplv2; lgplv2 1?
3 lgpl-3.0; lgplv3; lgplv3
3 agpl-3.0; affero; gnu? affero general public license version? (3|v3) 0?
3 agpl-3.0; agpl; gnu? agpl version? (3|v3) 0?
3 agpl-3.0; agplv3; agplv3
3 gfdl-1.2; documentation; gnu? free documentation license version? 1 2
3 gfdl-1.3; documentation; gnu? free documentation license version? 1 3
3 mpl-1.1; mozilla; mozilla public license version? 1 1
3 mpl-2.0; mozilla; mozilla public license version? (2|v2) 0?
3 mpl-2.0; mpl; mpl version? (2|v2) 0?
3 epl-1.0; eclipse; eclipse public license version? (1|v1) 0?
3 epl-2.0; eclipse; eclipse public license version? (2|v2) 0?
3 epl-2.0; epl; epl version? (2|v2) 0
3 edl-1.0; eclipse; eclipse distribution license version? (1|v1) 0?
3 cddl-1.0; cddl; cddl version? 1 0
3 cddl-1.1; cddl; cddl version? 1 1
3 cddl-1.0; distribution; common development and distribution license version? 1? 0?
3 cpl-1.0; common; common public license version? 1? 0?
3 eupl-1.2; european; european union public (license|licence) version? 1? 2?
3 eupl-1.2; eupl; eupl version? (1|v1) 2
3 artistic-1.0; artistic; artistic license version? 1 0?
3 artistic-2.0; artistic; artistic license version? 2 0?
3 bsl-1.0; boost; boost software license version? 1? 0?
3 busl-1.1; business; business source license version? 1? 1?
3 sspl-1.0; side; server side public license version? 1?
3 elastic-2.0; elastic; elastic license version? 2? 0?
3 psf-2.0; python; python software foundation license version? 2?
3 php-3.01; php; php license version? 3? 01?
3 ofl-1.1; font; sil? open font license version? 1? 1?
3 odbl-1.0; database; open data commons? open? database license version? 1? 0?
3 odbl-1.0; database; open database license version? 1? 0?
3 odc-by-1.0; commons; open data commons attribution license
3 pddl-1.0; dedication; public domain dedication and license
3 cc0-1.0; cc0; cc0 1? 0? universal?
3 cc0-1.0; zero; creative commons zero
3 cc-by-nc-sa; cc; cc by nc sa (2|3|4)? (0|5)?
3 cc-by-nc-nd; cc; cc by nc nd (2|3|4)? (0|5)?
3 cc-by-sa; cc; cc by sa (2|3|4)? (0|5)?
3 cc-by-nc; cc; cc by nc (2|3|4)? (0|5)?
3 cc-by-nd; cc; cc by nd (2|3|4)? (0|5)?
3 cc-by; cc; cc by (2|3|4) (0|5)?
3 cc-by-nc-sa; commons; creative commons attribution non? (commercial|noncommercial) share? (alike|sharealike) (2|3|4)? (0|5)?
3 cc-by-nc-nd; commons; creative commons attribution non? (commercial|noncommercial) no? (derivatives|derivs|noderivatives|noderivs) (2|3|4)? (0|5)?
3 cc-by-sa; commons; creative commons attribution share? (alike|sharealike) (2|3|4)? (0|5)?
3 cc-by-nc; commons; creative commons attribution non? (commercial|noncommercial) (2|3|4)? (0|5)?
3 cc-by-nd; commons; creative commons attribution no? (derivatives|derivs|noderivatives|noderivs) (2|3|4)? (0|5)?
3 ogl-3.0; government; open government (license|licence) version? v3? 3? 0?
4 apache; apache; apache software? license
4 mit; mit; mit license
4 mit; expat; expat license
4 mit-0; mit; mit no attribution
4 x11; x11; x11 license
4 isc; isc; isc license
4 bsd; bsd; bsd style? license
4 ncsa; ncsa; ncsa open? source? license
4 gpl; gnu; gnu general public license
4 gpl; gnu; gnu gpl
4 lgpl; lesser; gnu? lesser general public license
4 lgpl; gnu; gnu lgpl
4 agpl-3.0; affero; gnu? affero general public license
4 agpl-3.0; agpl; agpl
4 gfdl; documentation; gnu? free documentation license
4 mpl; mozilla; mozilla public license
4 epl; eclipse; eclipse public license
4 ms-pl; microsoft; microsoft public license
4 ms-rl; microsoft; microsoft reciprocal license
4 artistic; artistic; artistic license
4 zlib; zlib; zlib license
4 libpng; libpng; libpng license
4 openssl; openssl; openssl license
4 curl; curl; curl license
4 ruby; ruby; ruby license
4 wtfpl; wtfpl; wtfpl
4 unlicense; unlicense; the unlicense
4 postgresql; postgresql; postgresql license
4 openrail; openrail; openrail m? license?
4 llama; llama; llama 2? 3? community license
4 cc-by; commons; creative commons attribution
4 creative-commons; commons; creative commons license
4 public-domain; domain; (in|into) the public domain
4 public-domain; domain; public domain
4 proprietary; proprietary; proprietary license
4 commercial; commercial; commercial license
4 copyleft; copyleft; copyleft license
5 reserved; reserved; all rights reserved
5 reserved; reserved; some rights reserved
5 reserved; reproduced; no part of this (publication|work|book|document) may be reproduced
5 reserved; permission; without the prior written permission of
5 confidential; confidential; proprietary and confidential
5 confidential; confidential; confidential and proprietary
5 no-redistribution; redistribute; you may not redistribute
5 no-redistribution; redistribution; redistribution is (prohibited|forbidden)
5 non-commercial; commercial; for non commercial use only
5 non-commercial; noncommercial; for noncommercial use only
5 non-commercial; personal; for personal use only
5 research-only; research; for research (purposes|use) only
5 internal-use; internal; for internal use only
5 evaluation; evaluation; for evaluation purposes only
5 as-is; warranty; as is without warranty of any kind
5 copyright; copyright; copyright c
"""


def parsed() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, words) in the order of precedence."""
    out = []
    for line in TEXT.strip().splitlines():
        head, keyword, words = (x.strip() for x in line.split(";"))
        priority, label = head.split()
        out.append((int(priority), label, keyword, words))
    return out
