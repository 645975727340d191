"""The written signatures of the license scan: phrases that licenses, notices and their titles hold.

Each line of a table is ``label | priority | confidence | signature``. A word of a
signature with ``*`` is the keyword that gates it; see ``licenses.pattern`` for the
other marks. Priorities: 3 an exact license, 2 a license by its name, 1 a family or a
phrase that several licenses share, 0 a hint.
"""

from __future__ import annotations

TITLES = """
mit | 2 | 0.95 | mit license*
mit | 2 | 0.9 | the expat license*
mit | 2 | 0.95 | mit expat* license
mit-0 | 3 | 0.95 | mit no attribution*
mit-0 | 3 | 0.95 | mit 0 license*
x11 | 2 | 0.9 | x11* license
isc | 2 | 0.95 | isc* license
isc | 2 | 0.9 | internet systems consortium* license
bsd-2-clause | 3 | 1.0 | bsd* 2|two clause
bsd-2-clause | 3 | 1.0 | simplified bsd* license
bsd-2-clause | 3 | 0.95 | freebsd* license
bsd-2-clause | 3 | 1.0 | 2|two clause bsd* license
bsd-2-clause-patent | 3 | 1.0 | bsd* 2|two clause plus patent
bsd-3-clause | 3 | 1.0 | bsd* 3|three clause
bsd-3-clause | 3 | 1.0 | 3|three clause bsd* license
bsd-3-clause | 3 | 0.9 | new|modified|revised bsd* license
bsd-3-clause-clear | 3 | 1.0 | clear bsd* license
bsd-4-clause | 3 | 1.0 | bsd* 4|four clause
bsd-4-clause | 3 | 0.95 | original bsd* license
0bsd | 3 | 1.0 | 0|zero clause bsd*
0bsd | 3 | 1.0 | 0bsd*
0bsd | 3 | 0.95 | bsd* 0|zero clause
bsd | 1 | 0.8 | bsd* license
bsd | 1 | 0.8 | bsd* style license
bsd | 1 | 0.7 | under the bsd*
apache | 1 | 0.8 | apache* software? license
apache | 1 | 0.8 | apache* foundation license
apache-2.0 | 2 | 0.9 | al2* license
unlicense | 2 | 0.95 | the unlicense*
unlicense | 1 | 0.8 | unlicense*
wtfpl | 2 | 0.95 | wtfpl*
wtfpl | 3 | 1.0 | do what the fuck* you want to public license
zlib | 2 | 0.9 | zlib* license
zlib | 2 | 0.9 | zlib* libpng license
libpng | 2 | 0.9 | libpng* license
ncsa | 2 | 0.9 | ncsa* open source license
ncsa | 2 | 0.95 | university of illinois* ncsa
postgresql | 2 | 0.9 | postgresql* license
python | 2 | 0.9 | psf* license
python | 2 | 0.9 | python* software foundation license
python | 2 | 0.85 | python* license
ruby | 2 | 0.85 | ruby* license
php | 2 | 0.85 | the php* license
openssl | 2 | 0.9 | openssl* license
openssl | 2 | 0.9 | ssleay* license
curl | 2 | 0.9 | curl* license
vim | 2 | 0.9 | vim* license
tcl | 2 | 0.85 | tcl* tk license
ms-pl | 2 | 0.95 | microsoft* public license
ms-rl | 2 | 0.95 | microsoft* reciprocal license
ms-limited | 2 | 0.9 | microsoft* limited public license
sspl | 2 | 0.95 | server side public license*
sspl | 2 | 0.95 | sspl*
busl | 2 | 0.95 | business source license*
elastic | 2 | 0.95 | elastic* license
commons-clause | 2 | 0.95 | commons clause* license condition
polyform | 2 | 0.95 | polyform* noncommercial|shield|perimeter|strict license
prosperity | 2 | 0.9 | prosperity* public license
parity | 2 | 0.9 | parity* public license
hippocratic | 2 | 0.95 | hippocratic* license
json | 2 | 0.9 | json* license
artistic | 2 | 0.85 | artistic* license
artistic | 2 | 0.9 | the clarified artistic* license
epl | 2 | 0.85 | eclipse* public license
edl | 2 | 0.9 | eclipse* distribution license
mpl | 2 | 0.85 | mozilla* public license
cddl | 2 | 0.85 | common development* and distribution license
cpl | 2 | 0.85 | common* public license
ipl | 2 | 0.9 | ibm* public license
apsl | 2 | 0.9 | apple* public source license
nokia | 2 | 0.9 | nokia* open source license
sleepycat | 2 | 0.9 | sleepycat* license
qpl | 2 | 0.9 | q public* license
sissl | 2 | 0.9 | sun* industry standards source license
spl | 2 | 0.9 | sun* public license
intel | 2 | 0.85 | intel* open source license
w3c | 2 | 0.9 | w3c* software notice and license
w3c | 2 | 0.85 | w3c* document license
unicode | 2 | 0.9 | unicode* license agreement
icu | 2 | 0.9 | icu* license
boost | 2 | 0.9 | boost* software license
upl | 2 | 0.9 | universal permissive* license
eupl | 2 | 0.85 | european* union public license|licence
cecill | 2 | 0.95 | cecill* b|c? free? software? license
cecill | 1 | 0.8 | licence cecill*
mulan | 2 | 0.9 | mulan* permissive software license
blueoak | 2 | 0.95 | blue oak* model license
ofl | 2 | 0.9 | sil* open font license
ofl | 2 | 0.85 | open font* license
ubuntu-font | 2 | 0.95 | ubuntu* font license|licence
bitstream-vera | 2 | 0.9 | bitstream* vera fonts copyright
lppl | 2 | 0.85 | latex* project public license
gfdl | 2 | 0.85 | gnu* free documentation license
odbl | 2 | 0.9 | open database* license
odc-by | 2 | 0.9 | open data commons* attribution license
pddl | 2 | 0.9 | public domain* dedication and license
cdla-permissive | 2 | 0.95 | community data license* agreement permissive
cdla-sharing | 2 | 0.95 | community data license* agreement sharing
etalab | 2 | 0.9 | licence ouverte* open? license?
ogl-uk | 2 | 0.9 | open government* licence
dl-de | 2 | 0.9 | datenlizenz* deutschland
openrail | 2 | 0.95 | openrail* m|d|s? license?
openrail | 2 | 0.95 | creativeml* open rail m|d? license?
llama | 2 | 0.9 | llama* 2|3? community license
cern-ohl | 2 | 0.95 | cern* open hardware license|licence
solderpad | 2 | 0.95 | solderpad* hardware license
tapr-ohl | 2 | 0.9 | tapr* open hardware license
free-art | 2 | 0.9 | free art* license
against-drm | 2 | 0.9 | against drm* license
gpl | 1 | 0.8 | gnu? general* public license
gpl | 1 | 0.8 | gnu? gpl*
lgpl | 1 | 0.85 | gnu? lesser|library general* public license
agpl | 1 | 0.85 | gnu? affero* general public license
gpl-classpath | 2 | 0.95 | classpath* exception
gpl-linking | 1 | 0.7 | linking* exception
cc0-1.0 | 3 | 1.0 | cc0* 1 0
cc0 | 1 | 0.9 | cc0*
cc0-1.0 | 3 | 1.0 | creative* commons zero ~2 1 0
cc0 | 2 | 0.9 | creative* commons zero
cc | 0 | 0.6 | creative* commons
cc | 1 | 0.8 | creative* commons license
"""

NOTICES = """
apache-2.0 | 3 | 0.95 | you may not use this file except in compliance* with the license
apache-2.0 | 3 | 0.95 | www apache* org licenses license 2 0
apache | 1 | 0.7 | licensed to the apache* software foundation
apache | 1 | 0.8 | www apache* org licenses
gpl | 2 | 0.9 | it under the terms of the gnu general* public license
gpl | 2 | 0.9 | you should have received a copy of the gnu general* public license
gpl | 1 | 0.8 | published by the free software foundation* either version
gpl | 1 | 0.8 | www gnu* org licenses gpl
lgpl | 2 | 0.95 | it under the terms of the gnu lesser|library general* public license
lgpl | 2 | 0.95 | you should have received a copy of the gnu lesser|library general* public license
lgpl | 2 | 0.85 | www gnu* org licenses lgpl
agpl | 2 | 0.95 | it under the terms of the gnu affero* general public license
agpl | 2 | 0.95 | you should have received a copy of the gnu affero* general public license
agpl | 2 | 0.85 | www gnu* org licenses agpl
gfdl | 2 | 0.95 | under the terms of the gnu free documentation* license
gfdl | 1 | 0.7 | no invariant* sections
mpl-2.0 | 3 | 1.0 | this source code form is subject to the terms of the mozilla* public license v 2 0
mpl | 2 | 0.9 | subject to the terms of the mozilla* public license
mpl-1.1 | 3 | 0.95 | the contents of this file are subject to the mozilla* public license version 1 1
mpl | 1 | 0.8 | mozilla* org mpl
epl | 2 | 0.9 | made available under the terms of the eclipse* public license
epl | 1 | 0.8 | www eclipse* org legal epl
cddl | 2 | 0.9 | the terms of the common development* and distribution license
boost | 2 | 0.95 | distributed under the boost* software license
boost | 1 | 0.8 | www boost* org license
mit | 2 | 0.9 | licensed* under the? mit
mit | 2 | 0.9 | released* under the? mit
mit | 1 | 0.8 | opensource* org licenses mit
bsd | 1 | 0.8 | opensource* org licenses bsd
isc | 1 | 0.8 | opensource* org licenses isc
wtfpl | 2 | 0.9 | www wtfpl* net
unlicense | 2 | 0.9 | unlicense* org
ofl | 2 | 0.9 | scripts sil* org ofl
cc | 1 | 0.8 | creativecommons* org licenses
cc0 | 2 | 0.9 | creativecommons* org publicdomain zero
public-domain | 1 | 0.8 | in|into|to the public domain*
public-domain | 2 | 0.9 | dedicated|released|placed ~2 public domain*
public-domain | 2 | 0.9 | free and unencumbered* software released into the public domain
public-domain | 2 | 0.85 | no copyright* is claimed
public-domain | 2 | 0.85 | a work of the u s|united? states? government and is not subject to copyright*
public-domain | 1 | 0.7 | to the extent possible under law* ~12 waived
public-domain | 1 | 0.8 | public domain* mark
spdx | 0 | 0.4 | spdx* license identifier
reserved | 1 | 0.7 | all rights reserved*
reserved | 1 | 0.7 | todos los derechos* reservados
reserved | 1 | 0.7 | tous droits* réservés
reserved | 1 | 0.7 | alle rechte* vorbehalten
reserved | 0 | 0.6 | no rights? ~1 may be reproduced*
reserved | 1 | 0.7 | may not be reproduced* ~8 without ~3 permission
reserved | 1 | 0.7 | unauthorized* copying|reproduction|distribution|use of this
reserved | 1 | 0.7 | without the? prior written permission* of the publisher|author|copyright
copyright | 0 | 0.5 | copyright* c? <year>
copyright | 0 | 0.5 | copyright* c
copyright | 0 | 0.4 | copyright* holder|holders|notice
proprietary | 1 | 0.7 | proprietary* and confidential
proprietary | 1 | 0.7 | confidential* and proprietary
proprietary | 1 | 0.7 | trade secrets* of
proprietary | 1 | 0.7 | end user license agreement*
proprietary | 1 | 0.7 | subject to the terms of ~4 license agreement*
proprietary | 1 | 0.6 | for internal* use only
non-commercial | 1 | 0.7 | for non commercial* use only
non-commercial | 1 | 0.7 | for noncommercial* use only
non-commercial | 1 | 0.7 | for personal ~2 non commercial* use
non-commercial | 1 | 0.7 | not for commercial* use
research-only | 1 | 0.7 | for research* purposes only
evaluation | 1 | 0.6 | for evaluation* purposes only
other | 0 | 0.4 | licensed* under
other | 0 | 0.4 | released* under the? ~3 license
other | 0 | 0.4 | distributed* under the? ~4 license
other | 0 | 0.4 | available* under the? ~4 license
other | 0 | 0.4 | published* under the? ~4 license
other | 0 | 0.4 | dual* licensed
other | 0 | 0.4 | see the? license* file? for details
other | 0 | 0.4 | terms of the license*
"""

GRANTS = """
mit | 3 | 1.0 | permission is hereby granted* free of charge to any person obtaining a copy
mit | 2 | 0.9 | to use copy modify merge* publish distribute sublicense and or sell copies
mit | 2 | 0.9 | the above copyright notice and this permission notice shall be included* in all copies or substantial portions
mit | 2 | 0.85 | in no event shall the authors or copyright holders* be liable for any claim
x11 | 2 | 0.9 | the name of the x consortium* shall not be used
isc | 2 | 0.9 | permission* to use copy modify and or distribute this software for any purpose
isc | 2 | 0.9 | with or without fee is hereby granted provided that the above copyright* notice
isc | 1 | 0.8 | the author disclaims* all warranties with regard to this software
bsd | 1 | 0.8 | redistribution* and use in source and binary forms
bsd | 1 | 0.8 | redistributions* of source code must retain the above copyright notice
bsd | 1 | 0.8 | redistributions* in binary form must reproduce the above copyright notice
bsd-3-clause | 2 | 0.9 | neither the name of ~12 may be used to endorse* or promote products
bsd-3-clause | 2 | 0.85 | names? of its contributors may be used to endorse* or promote products
bsd-4-clause | 3 | 0.95 | all advertising* materials mentioning features or use of this software must display
bsd | 1 | 0.7 | this software is provided by the copyright holders* and contributors as is
apache-1.1 | 3 | 0.9 | products derived from this software may not be called apache*
apache-2.0 | 2 | 0.9 | subject to the terms and conditions of this license each contributor* hereby grants to you
apache-2.0 | 2 | 0.85 | unless required by applicable law or agreed to in writing* software distributed
apache-2.0 | 1 | 0.8 | limitations* under the license
gpl | 1 | 0.8 | this program is free software you can redistribute* it and or modify it
gpl | 1 | 0.8 | this program is distributed in the hope* that it will be useful
gpl | 1 | 0.7 | without even the implied warranty of merchantability* or fitness for a particular purpose
gpl | 2 | 0.9 | everyone is permitted to copy and distribute verbatim* copies of this license document
gpl | 2 | 0.9 | the licenses for most software are designed* to take away your freedom
gpl-2.0 | 2 | 0.9 | you must cause the modified files to carry prominent* notices
gpl-3.0 | 2 | 0.9 | conveying* verbatim copies
gpl-3.0 | 2 | 0.9 | you may convey* a covered work
gpl-3.0 | 2 | 0.85 | installation information* for a user product
lgpl | 2 | 0.9 | this library is free software you can redistribute* it
lgpl | 2 | 0.85 | a work that uses the library*
agpl-3.0 | 3 | 0.95 | remote network interaction* use with the gnu general public license
agpl | 2 | 0.85 | users interacting with it remotely* through a computer network
gfdl | 2 | 0.85 | to copy distribute and or modify this document* under the terms
mpl-2.0 | 2 | 0.9 | incompatible with secondary* licenses
mpl | 1 | 0.8 | covered* software is provided under this license on an as is basis
epl | 2 | 0.85 | each contributor* must include the program in a product offering
cddl | 2 | 0.85 | covered software* ~6 initial developer
artistic | 2 | 0.9 | the intent of this document is to state the conditions* under which a package may be copied
artistic-2.0 | 3 | 0.9 | you are permitted to use the standard* version and create and use modified versions
boost | 2 | 0.95 | obtaining a copy of the software and accompanying documentation covered by this license* to use
zlib | 3 | 0.95 | this software is provided as is without any express* or implied warranty in no event will the authors be held liable
zlib | 2 | 0.9 | the origin of this software must not be misrepresented*
zlib | 2 | 0.9 | altered source versions must be plainly marked* as such
wtfpl | 3 | 1.0 | you just do what the fuck* you want to
unlicense | 3 | 1.0 | anyone is free to copy modify publish use compile* sell or distribute this software
postgresql | 2 | 0.9 | permission to use copy modify and distribute this software and its documentation* for any purpose without fee
ncsa | 2 | 0.9 | to deal* with the software without restriction
openssl | 3 | 0.9 | this product includes software developed by the openssl* project
openssl | 2 | 0.9 | this product includes cryptographic* software written by eric young
python | 3 | 0.9 | psf* hereby grants licensee a nonexclusive royalty free
php-3.01 | 2 | 0.85 | products derived from this software may not be called php*
ms-pl | 2 | 0.9 | if you bring a patent* claim against any contributor
sspl | 2 | 0.9 | offering the program as a service* you must make the service source code available
busl | 2 | 0.9 | the licensor* hereby grants you the right to copy modify create derivative works redistribute and make non production use
elastic | 2 | 0.9 | you may not provide the software to third parties as a hosted* or managed service
commons-clause | 3 | 0.95 | the grant of rights under the license will not include and the license does not grant to you the right to sell* the software
json | 3 | 1.0 | the software shall be used for good not evil*
ofl | 2 | 0.9 | the fonts* including any derivative works can be bundled embedded redistributed
ofl | 2 | 0.9 | reserved font* name
cc0 | 2 | 0.9 | affirmer* hereby overtly fully permanently irrevocably and unconditionally waives
cc-by | 1 | 0.8 | you must give appropriate credit* provide a link to the license
cc-by-sa | 2 | 0.85 | distribute your contributions under the same* license as the original
cc-by-nc | 2 | 0.85 | you may not use the material for commercial* purposes
cc-by-nd | 2 | 0.85 | you may not distribute the modified* material
odbl | 2 | 0.85 | keep open* if you redistribute the database
openrail | 2 | 0.9 | use based restrictions* ~8 model
eupl | 2 | 0.9 | licensed under the eupl*
warranty | 0 | 0.4 | without warranty* of any kind
warranty | 0 | 0.4 | as is without warranty* of any kind express or implied
warranty | 0 | 0.4 | merchantability* and fitness for a particular purpose
warranty | 0 | 0.4 | in no event shall ~12 be liable* for any direct indirect incidental
"""


def written() -> list[tuple[str, str, int, float, str]]:
    """(label, keyword, priority, confidence, signature) of every line above."""
    out = []
    for line in (TITLES + NOTICES + GRANTS).strip().split("\n"):
        if not line:
            continue
        label, priority, confidence, signature = (x.strip() for x in line.split("|", 3))
        keyword = next(w for w in signature.split() if w.endswith("*")).rstrip("*")
        out.append((label, keyword, int(priority), float(confidence), signature.replace("*", "")))
    return out
