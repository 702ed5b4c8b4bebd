"""Known licence sentences and the rules over them.

Fixed values: wording of public licences and notices, normalised: A-Z lower-cased, all but letters, digits and inner
dots as one space, no dot before a space. Keys name the licence and the part of it that a sentence is.
"""

SENTENCES = {
    "mit.released": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit.liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache.licensed": "licensed under the apache license version 2.0",
    "apache.header": "licensed under the apache license version 2.0 the license",
    "apache.use": "you may not use this file except in compliance with the license",
    "apache.copy": "you may obtain a copy of the license at",
    "apache.copy_http": "you may obtain a copy of the license at http",
    "apache.copy_https": "you may obtain a copy of the license at https",
    "apache.basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache.limits": "see the license for the specific language governing permissions and limitations under the license",
    "gpl.work3": "this work is licensed under the gnu general public license version 3",
    "gpl.work2": "this work is licensed under the gnu general public license version 2",
    "gpl.later3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.later2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.only3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "gpl.only2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.details": "see the gnu general public license for more details",
    "gpl.received": "you should have received a copy of the gnu general public license along with this program",
    "lgpl.later3": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl.later21": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "lgpl.hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl.details": "see the gnu lesser general public license for more details",
    "agpl.later3": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl.details": "see the gnu affero general public license for more details",
    "bsd.use": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd.liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "cc.by_nc_short": "licensed under cc by nc 4.0",
    "cc.by_short": "licensed under cc by 4.0",
    "cc.by_sa_short": "licensed under cc by sa 4.0",
    "cc.by": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc.by_sa": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "cc.by_nc": "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc.warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "mpl.form": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "mpl.copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    "unlicense.free": "this is free and unencumbered software released into the public domain",
    "unlicense.anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib.warranty": "this software is provided as is without any express or implied warranty",
    "zlib.grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}

#: In order: a rule consumes what it matches, so the longer sequences stand first. Parts with ? may lack; other known sentences
#: end a match, text between does not.
RULES = (
    ("BSD-3-Clause", "bsd.use bsd.source bsd.binary bsd.names bsd.warranty? bsd.liability?"),
    ("BSD-2-Clause", "bsd.use bsd.source bsd.binary bsd.warranty? bsd.liability?"),
    ("MIT", "mit.released|mit.licensed? mit.grant mit.notice mit.warranty? mit.liability?"),
    ("Apache-2.0", "apache.licensed|apache.header apache.use apache.copy|apache.copy_http|apache.copy_https? apache.basis? apache.limits?"),
    ("LGPL-3.0-or-later", "lgpl.later3 lgpl.hope? lgpl.details?"),
    ("LGPL-2.1-or-later", "lgpl.later21 lgpl.hope? lgpl.details?"),
    ("AGPL-3.0-or-later", "agpl.later3 gpl.hope? agpl.details?"),
    ("GPL-3.0-or-later", "gpl.later3 gpl.hope? gpl.details? gpl.received?"),
    ("GPL-2.0-or-later", "gpl.later2 gpl.hope? gpl.details? gpl.received?"),
    ("GPL-3.0-only", "gpl.only3 gpl.hope? gpl.details? gpl.received?"),
    ("GPL-2.0-only", "gpl.only2 gpl.hope? gpl.details? gpl.received?"),
    ("ISC", "isc.grant isc.warranty?"),
    ("MPL-2.0", "mpl.form mpl.copy?"),
    ("Unlicense", "unlicense.free unlicense.anyone?"),
    ("Zlib", "zlib.warranty? zlib.grant"),
    ("MIT", "mit.released|mit.licensed"),
    ("Apache-2.0", "apache.licensed|apache.header"),
    ("GPL-3.0-only", "gpl.work3"),
    ("GPL-2.0-only", "gpl.work2"),
    ("CC-BY-NC-4.0", "cc.by_nc_short|cc.by_nc"),
    ("CC-BY-SA-4.0", "cc.by_sa_short|cc.by_sa"),
    ("CC-BY-4.0", "cc.by_short|cc.by"),
)
