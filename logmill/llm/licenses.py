"""License scans: ordered signature rules gated by keywords, overlaps resolved by priority and containment.

``FAMILIES`` are hand-written: for each licence a pattern of its name, of its address and of words of its text, each with a
keyword without which it can't match.  They become four kinds of rules, in order of priority: an SPDX tag, a grant
("licensed under ..."), the address, words of the text, and the bare name; ``NOTICES`` follow.

One Aho-Corasick pass over the case-folded text finds which keywords occur; only their rules run.  Of the matches, taken by
priority, then the longer, then the earlier, one is dropped if it lies within one that was taken.
Nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from logmill.llm.base import arrow_map, text_input

# licence; SPDX ids; keyword and pattern of the name; of the address; of its text.  "-" for none.
FAMILIES = r"""
MIT | MIT(?:-0)? | mit || mit\s+licen[cs]e | opensource.org/licenses/mit || opensource\.org/licenses/mit\b | obtaining a copy || permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy
Apache-2.0 | Apache-2\.0 | apache || apache(?:\s+software)?\s+licen[cs]e(?:,?\s+version|\s+v\.?)?\s*2(?:\.0)? | apache.org/licenses/license-2.0 || apache\.org/licenses/license-2\.0 | compliance || you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+(?:apache\s+)?licen[cs]e
Apache-1.1 | Apache-1\.1 | apache || apache(?:\s+software)?\s+licen[cs]e,?\s+(?:version\s+|v\.?\s*)?1\.1 | apache.org/licenses/license-1.1 || apache\.org/licenses/license-1\.1 | apache software foundation || this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+apache\s+software\s+foundation
BSD-3-Clause | BSD-3-Clause | bsd || (?:3|three)[\s-]clause\s+bsd(?:\s+licen[cs]e)?|bsd\s+(?:3|three)[\s-]clause(?:\s+licen[cs]e)? | opensource.org/licenses/bsd-3-clause || opensource\.org/licenses/bsd-3-clause | endorse or promote || neither\s+the\s+names?\s+of\s+.{1,80}?\s+may\s+be\s+used\s+to\s+endorse\s+or\s+promote
BSD-2-Clause | BSD-2-Clause | bsd || (?:2|two)[\s-]clause\s+bsd(?:\s+licen[cs]e)?|bsd\s+(?:2|two)[\s-]clause(?:\s+licen[cs]e)? | opensource.org/licenses/bsd-2-clause || opensource\.org/licenses/bsd-2-clause | redistributions in binary form || redistributions\s+in\s+binary\s+form\s+must\s+reproduce\s+the\s+above\s+copyright
BSD-4-Clause | BSD-4-Clause | bsd || (?:4|four)[\s-]clause\s+bsd(?:\s+licen[cs]e)?|original\s+bsd\s+licen[cs]e | spdx.org/licenses/bsd-4-clause || spdx\.org/licenses/bsd-4-clause | advertising materials || all\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use
0BSD | 0BSD | bsd || zero[\s-]clause\s+bsd(?:\s+licen[cs]e)?|bsd\s+zero[\s-]clause | opensource.org/licenses/0bsd || opensource\.org/licenses/0bsd | for any purpose with or without fee || use,\s+copy,\s+modify,\s+and/or\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee\s+is\s+hereby\s+granted\.\s+the
ISC | ISC | isc || isc\s+licen[cs]e | opensource.org/licenses/isc || opensource\.org/licenses/isc\b | above copyright notice and this permission || provided\s+that\s+the\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+appear\s+in\s+all\s+copies
GPL-2.0 | GPL-2\.0(?:-only|-or-later|\+)? | gpl || (?:gnu\s+)?gpl(?:\s*v|\s+version\s+|[\s-])2(?:\.0)?(?:\s+or\s+later)? | gnu.org/licenses/old-licenses/gpl-2.0 || gnu\.org/licenses/old-licenses/gpl-2\.0 | version 2 of the license || gnu\s+general\s+public\s+licen[cs]e\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation[;,]?\s+(?:either\s+)?version\s+2\s+of\s+the\s+license
GPL-3.0 | GPL-3\.0(?:-only|-or-later|\+)? | gpl || (?:gnu\s+)?gpl(?:\s*v|\s+version\s+|[\s-])3(?:\.0)?(?:\s+or\s+later)? | gnu.org/licenses/gpl-3.0 || gnu\.org/licenses/gpl-3\.0 | version 3 of the license || gnu\s+general\s+public\s+licen[cs]e\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation[;,]?\s+(?:either\s+)?version\s+3\s+of\s+the\s+license
LGPL-2.1 | LGPL-2\.1(?:-only|-or-later|\+)? | lgpl || (?:gnu\s+)?lgpl(?:\s*v|\s+version\s+|[\s-])2\.1 | gnu.org/licenses/old-licenses/lgpl-2.1 || gnu\.org/licenses/old-licenses/lgpl-2\.1 | lesser general public || gnu\s+lesser\s+general\s+public\s+licen[cs]e,?\s+(?:as\s+published.{1,60}?)?version\s+2\.1
LGPL-3.0 | LGPL-3\.0(?:-only|-or-later|\+)? | lgpl || (?:gnu\s+)?lgpl(?:\s*v|\s+version\s+|[\s-])3(?:\.0)? | gnu.org/licenses/lgpl-3.0 || gnu\.org/licenses/lgpl-3\.0 | lesser general public || gnu\s+lesser\s+general\s+public\s+licen[cs]e,?\s+(?:as\s+published.{1,60}?)?version\s+3
LGPL-2.0 | LGPL-2\.0(?:-only|-or-later|\+)? | lgpl || (?:gnu\s+)?lgpl(?:\s*v|\s+version\s+|[\s-])2(?:\.0)?(?!\.1) | gnu.org/licenses/old-licenses/lgpl-2.0 || gnu\.org/licenses/old-licenses/lgpl-2\.0 | library general public || gnu\s+library\s+general\s+public\s+licen[cs]e
AGPL-3.0 | AGPL-3\.0(?:-only|-or-later|\+)? | agpl || (?:gnu\s+)?agpl(?:\s*v|\s+version\s+|[\s-])?3?(?:\.0)? | gnu.org/licenses/agpl || gnu\.org/licenses/agpl(?:-3\.0)? | affero general public || gnu\s+affero\s+general\s+public\s+licen[cs]e(?:,?\s+version\s+3)?
GFDL-1.3 | GFDL-1\.3(?:-only|-or-later)? | gfdl || (?:gnu\s+)?gfdl(?:[\s-]?v?1\.3)? | gnu.org/licenses/fdl || gnu\.org/licenses/fdl(?:-1\.3)? | free documentation || gnu\s+free\s+documentation\s+licen[cs]e(?:,?\s+version\s+1\.[0-3])?
MPL-2.0 | MPL-2\.0 | mpl || mpl[\s-]?(?:v\.?)?2(?:\.0)? | mozilla.org/mpl/2.0 || mozilla\.org/mpl/2\.0 | mozilla public || mozilla\s+public\s+licen[cs]e,?\s*(?:version\s+|v\.?\s*)?2\.0
MPL-1.1 | MPL-1\.1 | mpl || mpl[\s-]?(?:v\.?)?1\.1 | mozilla.org/mpl/1.1 || mozilla\.org/mpl/1\.1 | mozilla public || mozilla\s+public\s+licen[cs]e,?\s*(?:version\s+|v\.?\s*)?1\.1
EPL-2.0 | EPL-2\.0 | epl || epl[\s-]?(?:v\.?)?2(?:\.0)? | eclipse.org/legal/epl-2.0 || eclipse\.org/legal/epl-2\.0 | eclipse public || eclipse\s+public\s+licen[cs]e,?\s*(?:-\s*)?(?:version\s+|v\.?\s*)?2\.0
EPL-1.0 | EPL-1\.0 | epl || epl[\s-]?(?:v\.?)?1\.0 | eclipse.org/legal/epl-v10 || eclipse\.org/legal/epl-v10 | eclipse public || eclipse\s+public\s+licen[cs]e,?\s*(?:-\s*)?(?:version\s+|v\.?\s*)?1\.0
EUPL-1.2 | EUPL-1\.[012] | eupl || eupl(?:[\s-]?v?\.?\s*1\.[012])? | joinup.ec.europa.eu || joinup\.ec\.europa\.eu/\S*eupl | european union public || european\s+union\s+public\s+licen[cs]e
CDDL-1.0 | CDDL-1\.[01] | cddl || cddl(?:[\s-]?v?1\.[01])? | opensource.org/licenses/cddl || opensource\.org/licenses/cddl | common development and distribution || common\s+development\s+and\s+distribution\s+licen[cs]e
CPL-1.0 | CPL-1\.0 | common public || common\s+public\s+licen[cs]e(?:\s+v?1\.0)? | opensource.org/licenses/cpl || opensource\.org/licenses/cpl1\.0 | accompanying program || the\s+accompanying\s+program\s+is\s+provided\s+under\s+the\s+terms\s+of\s+this\s+common\s+public
CC0-1.0 | CC0-1\.0 | cc0 || cc0(?:[\s-]1\.0)?(?:\s+universal)? | creativecommons.org/publicdomain/zero || creativecommons\.org/publicdomain/zero/1\.0 | waived || waived\s+all\s+(?:of\s+)?(?:his|her|their|its)?\s*.{0,60}?copyright
CC-BY-4.0 | CC-BY-[1-4]\.0 | cc || cc[\s-]by[\s-](?:[1-4]\.[05])(?:\s+international)? | creativecommons.org/licenses/by/ || creativecommons\.org/licenses/by/[1-4]\.[05] | creative commons attribution || creative\s+commons\s+attribution\s+(?:[1-4]\.[05]|licen[cs]e|international)
CC-BY-SA-4.0 | CC-BY-SA-[1-4]\.0 | cc || cc[\s-]by[\s-]sa(?:[\s-][1-4]\.[05])?(?:\s+international)? | creativecommons.org/licenses/by-sa || creativecommons\.org/licenses/by-sa/[1-4]\.[05] | creative commons attribution || creative\s+commons\s+attribution[\s-]+share[\s-]?alike(?:\s+[1-4]\.[05])?
CC-BY-NC-4.0 | CC-BY-NC-[1-4]\.0 | cc || cc[\s-]by[\s-]nc(?:[\s-][1-4]\.[05])(?:\s+international)? | creativecommons.org/licenses/by-nc/ || creativecommons\.org/licenses/by-nc/[1-4]\.[05] | creative commons attribution || creative\s+commons\s+attribution[\s-]+non[\s-]?commercial(?:\s+[1-4]\.[05])?
CC-BY-ND-4.0 | CC-BY-ND-[1-4]\.0 | cc || cc[\s-]by[\s-]nd(?:[\s-][1-4]\.[05])?(?:\s+international)? | creativecommons.org/licenses/by-nd || creativecommons\.org/licenses/by-nd/[1-4]\.[05] | creative commons attribution || creative\s+commons\s+attribution[\s-]+no[\s-]?deriv(?:ative)?s?(?:\s+[1-4]\.[05])?
CC-BY-NC-SA-4.0 | CC-BY-NC-SA-[1-4]\.0 | cc || cc[\s-]by[\s-]nc[\s-]sa(?:[\s-][1-4]\.[05])?(?:\s+international)? | creativecommons.org/licenses/by-nc-sa || creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05] | creative commons attribution || creative\s+commons\s+attribution[\s-]+non[\s-]?commercial[\s-]+share[\s-]?alike
CC-BY-NC-ND-4.0 | CC-BY-NC-ND-[1-4]\.0 | cc || cc[\s-]by[\s-]nc[\s-]nd(?:[\s-][1-4]\.[05])?(?:\s+international)? | creativecommons.org/licenses/by-nc-nd || creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05] | creative commons attribution || creative\s+commons\s+attribution[\s-]+non[\s-]?commercial[\s-]+no[\s-]?deriv
Unlicense | Unlicense | unlicense || the\s+unlicense | unlicense.org || unlicense\.org | unencumbered software || free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain
WTFPL | WTFPL | wtfpl || wtfpl(?:\s+v?2)? | wtfpl.net || wtfpl\.net | what the fuck you want || do\s+what\s+the\s+fuck\s+you\s+want\s+to(?:\s+public\s+licen[cs]e)?
Zlib | Zlib | zlib || zlib(?:/libpng)?\s+licen[cs]e | zlib.net || zlib\.net/zlib_license | altered source versions || altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked
BSL-1.0 | BSL-1\.0 | boost || boost\s+software\s+licen[cs]e(?:[\s,-]+(?:version\s+|v)?1\.0)? | boost.org/licen || boost\.org/licen[cs]e_1_0 | machine-executable object code || machine-executable\s+object\s+code\s+generated\s+by\s+a\s+source\s+language\s+processor
Artistic-2.0 | Artistic-2\.0 | artistic || artistic\s+licen[cs]e(?:\s+(?:version\s+|v)?2\.0) | artistic || (?:opensource|perlfoundation)\.org/\S*artistic[-_]licen[cs]e[-_]2 | standard version || distribute\s+verbatim\s+copies\s+of\s+the\s+standard\s+version
Artistic-1.0 | Artistic-1\.0(?:-Perl)? | artistic || artistic\s+licen[cs]e(?:\s+(?:version\s+|v)?1\.0)? | dev.perl.org/licenses || dev\.perl\.org/licenses/artistic | same terms as perl || under\s+the\s+same\s+terms\s+as\s+perl\s+itself
PSF-2.0 | (?:PSF|Python)-2\.0 | python software || python\s+software\s+foundation\s+licen[cs]e(?:\s+(?:version\s+)?2)? | docs.python.org/ || docs\.python\.org/(?:3/)?license | psf hereby grants || psf\s+hereby\s+grants\s+licensee\s+a\s+nonexclusive
PostgreSQL | PostgreSQL | postgresql || postgresql\s+licen[cs]e | postgresql.org/about/licence || postgresql\.org/about/licence | without a written agreement || without\s+fee,\s+and\s+without\s+a\s+written\s+agreement\s+is\s+hereby\s+granted
OpenSSL | OpenSSL | openssl || openssl\s+licen[cs]e | openssl.org/source/license || openssl\.org/source/license | openssl toolkit || for\s+use\s+in\s+the\s+openssl\s+toolkit
PHP-3.01 | PHP-3\.01 | php || php\s+licen[cs]e(?:,?\s+(?:version\s+|v)?3\.0?1) | php.net/license || php\.net/license/3_01 | available || includes\s+php\s+software,?\s+freely\s+available
Ruby | Ruby | ruby || ruby\s+licen[cs]e | ruby-lang.org/ || ruby-lang\.org/\S*license | terms || under\s+the\s+same\s+terms\s+as\s+ruby(?:'s\s+license)?
MS-PL | MS-PL | microsoft public || microsoft\s+public\s+licen[cs]e | opensource.org/licenses/ms-pl || opensource\.org/licenses/ms-pl | accompanying || this\s+licen[cs]e\s+governs\s+use\s+of\s+the\s+accompanying\s+software
MS-RL | MS-RL | microsoft reciprocal || microsoft\s+reciprocal\s+licen[cs]e | opensource.org/licenses/ms-rl || opensource\.org/licenses/ms-rl | reciprocal grants || reciprocal\s+grants-\s+for\s+any\s+file
OFL-1.1 | OFL-1\.1 | ofl || (?:sil\s+)?ofl[\s-]?1\.1 | scripts.sil.org/ofl || scripts\.sil\.org/ofl | open font || (?:sil\s+)?open\s+font\s+licen[cs]e(?:,?\s+version\s+1\.1)?
ODbL-1.0 | ODbL-1\.0 | odbl || odbl(?:[\s-]1\.0)? | opendatacommons.org/licenses/odbl || opendatacommons\.org/licenses/odbl | open database || open\s+database\s+licen[cs]e
ODC-By-1.0 | ODC-By-1\.0 | odc || odc[\s-]by(?:[\s-]1\.0)? | opendatacommons.org/licenses/by || opendatacommons\.org/licenses/by\b | open data commons || open\s+data\s+commons\s+attribution
PDDL-1.0 | PDDL-1\.0 | pddl || pddl(?:[\s-]1\.0)? | opendatacommons.org/licenses/pddl || opendatacommons\.org/licenses/pddl | public domain dedication || public\s+domain\s+dedication\s+and\s+licen[cs]e
OGL-UK-3.0 | OGL-UK-3\.0 | ogl || ogl(?:[\s-]uk)?[\s-]?v?3(?:\.0)? | nationalarchives.gov.uk/doc/open-government || nationalarchives\.gov\.uk/doc/open-government-licen[cs]e | open government || open\s+government\s+licen[cs]e(?:\s+v?\s*3(?:\.0)?)?
NCSA | NCSA | ncsa || (?:university\s+of\s+illinois/)?ncsa\s+open\s+source\s+licen[cs]e | opensource.org/licenses/ || opensource\.org/licenses/(?:ui-)?ncsa | university of illinois || university\s+of\s+illinois\s+open\s+source\s+licen[cs]e
AFL-3.0 | AFL-3\.0 | academic free || academic\s+free\s+licen[cs]e(?:\s+(?:version\s+|v\.?\s*)?[23]\.[01])? | opensource.org/licenses/afl || opensource\.org/licenses/afl-3\.0 | licensed under the academic || licensed\s+under\s+the\s+academic\s+free
OSL-3.0 | OSL-3\.0 | open software license || open\s+software\s+licen[cs]e(?:\s+(?:version\s+|v\.?\s*)?[123]\.[01])? | opensource.org/licenses/osl || opensource\.org/licenses/osl-3\.0 | licensed under the open software || licensed\s+under\s+the\s+open\s+software\s+licen[cs]e
UPL-1.0 | UPL-1\.0 | universal permissive || universal\s+permissive\s+licen[cs]e(?:[\s,]+v?1\.0)? | opensource.org/licenses/upl || opensource\.org/licenses/upl | larger works || larger\s+works.{0,80}?universal\s+permissive
Vim | Vim | vim || vim\s+licen[cs]e | vimhelp.org/uganda || vimhelp\.org/uganda | unmodified copies of vim || distribute\s+unmodified\s+copies\s+of\s+vim
X11 | X11 | x11 || x11\s+licen[cs]e | xfree86.org || xfree86\.org/\S*license | x consortium || except\s+as\s+contained\s+in\s+this\s+notice,\s+the\s+name\s+of\s+the\s+x\s+consortium
JSON | JSON | json || json\s+licen[cs]e | json.org/license || json\.org/license | not evil || shall\s+be\s+used\s+for\s+good,\s+not\s+evil
SSPL-1.0 | SSPL-1\.0 | sspl || sspl(?:[\s-]v?1(?:\.0)?)? | mongodb.com/licensing || mongodb\.com/licensing/server-side-public-license | server side public || server\s+side\s+public\s+licen[cs]e
Elastic-2.0 | Elastic-2\.0 | elastic || elastic\s+licen[cs]e(?:\s+v?2(?:\.0)?)? | elastic.co/licensing || elastic\.co/licensing/elastic-license | hosted or managed service || provide\s+the\s+software\s+to\s+third\s+parties\s+as\s+a\s+hosted\s+or\s+managed\s+service
BUSL-1.1 | BUSL-1\.1 | business source || business\s+source\s+licen[cs]e(?:\s+(?:version\s+)?1\.1)? | mariadb.com/bsl11 || mariadb\.com/bsl11 | additional use grant || additional\s+use\s+grant
RAIL | (?:Open|Creative)?-?RAIL(?:-[A-Z])? | rail || (?:open|creativeml|bigscience)[\s-]*(?:open)?rail(?:[\s-]?\+?\+?[md])? | bigscience.huggingface.co || bigscience\.huggingface\.co/\S*rail | use-based restrictions || use-based\s+restrictions\s+as\s+referenced
HPND | HPND | historical permission || historical\s+permission\s+notice\s+and\s+disclaimer | opensource.org/licenses/hpnd || opensource\.org/licenses/hpnd | for any purpose and without fee || for\s+any\s+purpose\s+and\s+without\s+fee\s+is\s+hereby\s+granted
CeCILL-2.1 | CECILL-2\.[01] | cecill || cecill(?:[\s-]?v?2(?:\.[01])?)? | cecill.info || cecill\.info/licences | cecill || (?:soumis\s+à\s+la|governed\s+by\s+the)\s+(?:licence\s+(?:de\s+logiciel\s+libre\s+)?)?cecill
QPL-1.0 | QPL-1\.0 | q public || q\s+public\s+licen[cs]e(?:\s+v(?:ersion\s+)?1\.0)? | opensource.org/licenses/qpl || opensource\.org/licenses/qpl | trolltech || copyright\s+.{0,40}?trolltech\s+as
Sleepycat | Sleepycat | sleepycat || sleepycat\s+(?:public\s+)?licen[cs]e | opensource.org/licenses/sleepycat || opensource\.org/licenses/sleepycat | accompanying software that uses || any\s+accompanying\s+software\s+that\s+uses\s+the\s+(?:db\s+)?software
Beerware | Beerware | beer || (?:the\s+)?beer-?ware\s+licen[cs]e | people.freebsd.org || people\.freebsd\.org/~phk | buy me a beer || you\s+can\s+buy\s+me\s+a\s+beer\s+in\s+return
Intel | Intel | intel || intel\s+open\s+source\s+licen[cs]e | opensource.org/licenses/intel || opensource\.org/licenses/intel-open-source | intel corporation or its contributors || intel\s+corporation\s+or\s+its\s+contributors\s+be\s+liable
NASA-1.3 | NASA-1\.3 | nasa open source || nasa\s+open\s+source\s+agreement(?:\s+(?:version\s+)?1\.3)? | opensource.org/licenses/nasa || opensource\.org/licenses/nasa1\.3 | government agency || government\s+agency:?\s+national\s+aeronautics
W3C | W3C(?:-\d+)? | w3c || w3c\s+(?:software\s+)?(?:notice\s+and\s+)?licen[cs]e | w3.org/consortium/legal || w3\.org/consortium/legal/\S*copyright-software | w3c liability || w3c\s+liability,\s+trademark
"""
NOTICES = r"""
all-rights-reserved | all rights reserved || \ball\s+rights\s+reserved\b
copyright | copyright || \bcopyright\s+(?:\(c\)|©)?\s*(?:19|20)\d\d(?:\s*[-–,]\s*(?:19|20)?\d\d)*\b
copyright-sign | © || ©\s*(?:19|20)\d\d(?:\s*[-–,]\s*(?:19|20)?\d\d)*\b
public-domain | public domain || \b(?:placed|released|is|are)\s+in(?:to)?\s+the\s+public\s+domain\b
proprietary | proprietary || \bproprietary\s+(?:and|&)\s+confidential\b
unauthorized-copying | unauthori || \bunauthori[sz]ed\s+(?:copying|reproduction|distribution|use)\b
no-redistribution | may || \bmay\s+not\s+be\s+(?:copied|reproduced|redistributed)\b
personal-use | personal use || \bfor\s+personal(?:,?\s+non-?commercial)?\s+use\s+only\b
non-commercial | commercial || \b(?:for\s+)?non-?commercial\s+(?:use|purposes)\s+only\b
used-with-permission | permission || \b(?:used|reprinted|reproduced)\s+(?:with|by)\s+permission\b
alle-rechte | rechte vorbehalten || \balle\s+rechte\s+vorbehalten\b
tous-droits | droits r || \btous\s+droits\s+réservés\b
todos-derechos | derechos reservados || \btodos\s+los\s+derechos\s+reservados\b
subscription | subscri || \bsubscribers?\s+only\s+content\b
terms-of-service | terms of || \bsubject\s+to\s+(?:the\s+)?terms\s+of\s+(?:service|use)\b
do-not-distribute | distribute || \bdo\s+not\s+(?:copy\s+or\s+)?distribute\b
patent | patent || \bpatents?\s+pending\b
trade-secret | trade secret || \btrade\s+secrets?\s+of\b
gpl-unversioned | general public || \bgnu\s+general\s+public\s+licen[cs]e\b
see-license | licen || \bsee\s+(?:the\s+)?licen[cs]e(?:\.txt|\.md)?\s+file\b
"""
_GRANT = r"(?:licen[cs]ed\s+(?:to\s+you\s+)?under|released\s+under|distributed\s+under|available\s+under|covered\s+by|subject\s+to)\s+(?:the\s+terms\s+of\s+)?(?:the\s+|an?\s+)?"


@dataclass(frozen=True)
class Rule:
    rule_id: int
    license: str
    kind: str
    priority: int
    keyword: str
    pattern: str


def _rules() -> list[Rule]:
    found: list[tuple[str, str, int, str, str]] = []
    for line in FAMILIES.strip().splitlines():
        # single bars within a pattern have no blank on both sides
        name, spdx, *rest = re.split(r" \| ", line)
        (name_key, name_pattern), (url_key, url), (words_key, words) = (x.split(" || ") for x in rest)
        found += [
            (name, "tag", 0, "spdx-license-identifier", rf"spdx-license-identifier:\s*\(?{spdx}(?![\w.+-]*\w)"),
            (name, "grant", 1, name_key, rf"\b{_GRANT}(?:{name_pattern})"),
            (name, "address", 2, url_key, url),
            (name, "text", 3, words_key, words),
            (name, "name", 4, name_key, rf"\b(?:{name_pattern})(?!\w)"),
        ]
    for line in NOTICES.strip().splitlines():
        name, rest = line.split(" | ")
        key, pattern = rest.split(" || ")
        found.append((name, "notice", 5, key, pattern))
    return [Rule(i, *x) for i, x in enumerate(found)]


RULES = _rules()


def resolve(matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (priority, rule_id, start, end) those that don't lie within one taken before, by start.

    Taken in order of priority, then the longer, the earlier, the lesser rule_id.  A binary indexed tree over the starts keeps the
    greatest end taken so far, so a text with very many matches costs no square of them.
    """
    starts = sorted({m[2] for m in matches})
    place = {s: i + 1 for i, s in enumerate(starts)}
    furthest = [-1] * (len(starts) + 1)
    taken: list[tuple[int, int, int, int]] = []
    for m in sorted(set(matches), key=lambda m: (m[0], m[2] - m[3], m[2], m[1])):
        i, end = place[m[2]], -1
        while i:
            end = max(end, furthest[i])
            i &= i - 1
        if end >= m[3]:
            continue
        taken.append(m)
        i = place[m[2]]
        while i < len(furthest):
            furthest[i] = max(furthest[i], m[3])
            i += i & -i
    return sorted(taken, key=lambda m: (m[2], m[3], m[1]))


class Scanner:
    def __init__(self, rules: list[Rule]) -> None:
        self.compiled = [re.compile(r.pattern, re.I | re.S) for r in rules]
        self.rules, by_key = rules, {}
        for i, r in enumerate(rules):
            by_key.setdefault(r.keyword, []).append(i)
        # white space of any kind may stand for a blank, so a keyword is looked for by its longest word
        self.automaton = ahocorasick.Automaton()
        by_word: dict[str, list[int]] = {}
        for key, ids in by_key.items():
            by_word.setdefault(max(key.split(), key=len), []).extend(ids)
        for word, ids in by_word.items():
            self.automaton.add_word(word, tuple(ids))
        if by_word:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> set[int]:
        if not self.rules:
            return set()
        return {i for _, ids in self.automaton.iter(text.casefold()) for i in ids}

    def scan(self, text: str, prefilter: bool = True) -> list[tuple[int, int, int, int]]:
        """(priority, rule_id, start, end) of what ``resolve`` takes."""
        which = self.candidates(text) if prefilter else range(len(self.rules))
        found = []
        for i in which:
            r = self.rules[i]
            found += [(r.priority, i, m.start(), m.end()) for m in self.compiled[i].finditer(text) if m.end() > m.start()]
        return resolve(found) if found else []


def detections(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, license, kind, rule_id, start_char, end_char): what is found in each document, ``end_char`` excluded.

    Null or empty text: nothing.  Null doc_id: searched like any other row.  Repeated rows: their detections once each.
    Ties of one priority: the longer, then the earlier, then the lesser rule_id is taken; two equal spans leave one.
    Very long texts are searched whole.  Empty table or no rules: no rows.
    """
    rules = RULES if rules is None else rules

    def each(b: pa.RecordBatch, state: dict = {}) -> pa.RecordBatch | None:  # noqa: B006 - one scanner a worker
        if "scanner" not in state:
            state["scanner"] = Scanner(rules)
        scanner = state["scanner"]
        rows = [(k, m) for k, t in enumerate(b.column(1).to_pylist()) if t for m in scanner.scan(t)]
        if not rows:
            return None
        hit = [rules[m[1]] for _, m in rows]
        columns = [
            b.column(0).take(pa.array([k for k, _ in rows], pa.int64())),
            pa.array([r.license for r in hit]),
            pa.array([r.kind for r in hit]),
            pa.array([r.rule_id for r in hit], pa.int64()),
            pa.array([m[2] for _, m in rows], pa.int64()),
            pa.array([m[3] for _, m in rows], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "license", "kind", "rule_id", "start_char", "end_char"])

    return arrow_map(text_input(docs), each, "doc_id bigint, license string, kind string, rule_id bigint, start_char bigint, end_char bigint")
