"""Templates of open licenses, in the markup of ``licenses``: ``[[a|b]]`` optional, ``{{n}}`` one to n words of any kind."""

_BSD_HEAD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
[[1|a]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
[[2|b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
in the documentation and or other materials provided with the distribution"""
_BSD_END = """this software is provided by {{8}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and
fitness for a particular purpose are disclaimed in no event shall {{8}} be liable for any direct indirect incidental special exemplary or consequential damages
including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of
liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the
possibility of such damage"""
_GNU = """this {{4}} is free software you can redistribute it and or modify it under the terms of the gnu {{2}} public license as published by the free software
foundation [[either]] version {{2}} [[of the license]] [[or at your option any later version]]"""

# The wording of licenses and of their notices.
TEMPLATES = {
    "0bsd-text": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
        and the author disclaims all warranties""",
    "agpl-notice": "under the terms of the gnu affero general public license",
    "apache-header": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy
        of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license
        is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing
        permissions and limitations under the license""",
    "apache-notice": "licensed under the apache license [[version {{2}}]]",
    "boost-text": """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by
        this license the software to use reproduce display distribute execute and transmit the software""",
    "bsd-2-text": f"{_BSD_HEAD} {_BSD_END}",
    "bsd-3-text": f"""{_BSD_HEAD} [[3|c]] neither the name of {{{{8}}}} nor the names of [[its|the]] contributors may be used to endorse or promote products derived
        from this software without specific prior written permission {_BSD_END}""",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-notice": """licensed under [[a|the]] [[creative commons]] cc by [[nc]] [[sa|nd]] [[{{2}} license]]""",
    "cc-text": "licensed under [[a|the]] creative commons attribution [[noncommercial|non commercial]] [[sharealike|share alike|noderivatives|no derivatives]]",
    "gnu-header": _GNU,
    "gnu-warranty": """is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a
        particular purpose see the gnu {{2}} public license for more details""",
    "gpl-notice": "licensed under the [[terms of the]] gnu [[lesser|affero]] general public license [[version {{2}}]]",
    "isc-text": """permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above
        copyright notice and this permission notice appear in all copies""",
    "lgpl-notice": "under the terms of the gnu lesser general public license",
    "mit-notice": "[[released|licensed|distributed]] under the [[terms of the]] mit license",
    "mit-permission": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to
        deal in {{2}} software without restriction""",
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in
        the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
        and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any
        kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
        {{8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software
        or the use or other dealings in the software""",
    "mpl-header": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain
        one at [[http|https]] mozilla org mpl 2 0""",
    "unlicense-text": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this
        software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""",
    "warranty": "the software is provided as is without warranty of any kind express or implied",
    "zlib-text": """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of
        this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely""",
}
