"""Grammars of seven languages over collapsed token strings.

A bracket group is one token by the time its surroundings are parsed, so every rule speaks of one nesting level. The
tokens: ``i`` identifier, ``0`` number, ``s`` string (template, character, pattern), punctuation as itself; keywords and
longer operators have characters of the private use area. ``LISTS`` names the groups that hold statements or members,
``KINDS`` the readings tried for a group's content.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from cairn.llm.chart import Grammar

_BASE = 0xE000


@dataclass
class Syntax:
    """What the reducer needs to know of a language."""

    name: str
    keywords: str
    contextual: str
    operators: str
    rules: str
    kinds: dict[str, list[str]]
    lists: dict[str, str]
    top: str
    continues: str = ""
    newline: str = ""
    spelling: dict[str, str] = field(default_factory=dict)
    grammar: Grammar | None = None

    def build(self) -> Syntax:
        words = [*self.keywords.split(), *self.contextual.split()]
        ops = self.operators.split()
        for k, w in enumerate([*words, *ops]):
            self.spelling[w] = chr(_BASE + k)
        sp = self.spelling | {c: c for c in "+-*/%<>=!&|^~?:;,.@#$i0s_\\`"}
        soft = {sp[w] for w in self.contextual.split()}
        hard = {sp[w] for w in self.keywords.split()}
        sets = {"id": {"i", *soft}, "num": {"0"}, "str": {"s"}, "name": {"i", *soft, *hard}}
        for line in self.rules.split("\n"):
            if line.startswith("set "):
                n, members = line[4:].split(":", 1)
                sets[n.strip()] = {sp[m] for m in members.split()}
        self.grammar = Grammar("\n".join(x for x in self.rules.split("\n") if not x.startswith("set ")), sp, sets)
        return self


_JS_STMT = """STMTs = STMT+
STMT = BLOCK | vardecl ';' | !nostart expr ';' | ';' | 'if' P.expr STMT ('else' STMT)? | 'for' 'await'? P.for STMT | 'while' P.expr STMT
  | 'do' STMT 'while' P.expr ';'? | 'switch' P.expr BLOCK | 'throw' expr ';' | 'try' BLOCK ('catch' P.params? BLOCK ('finally' BLOCK)? | 'finally' BLOCK) RETURN
  | 'break' id? ';' | 'continue' id? ';' | named | id ':' STMT | 'case' expr ':' | 'default' ':' | 'debugger' ';' TSTMT
"""
#: A statement outside functions knows no return; blocks are read in both ways.
_JS_STATEMENTS = _JS_STMT.replace("TSTMT", "T#").replace("STMT", "stmt").replace("T#", "TSTMT").replace("BLOCK", "C.block").replace("RETURN", "") + _JS_STMT.replace("TSTMT", "T#").replace("STMT", "fstmt").replace("T#", "TSTMT").replace("BLOCK", "C.fblock").replace("RETURN", "| 'return' expr? ';'")
_JS_RULES = """
set nostart: function class
set none:
set uop: ! ~ + - ++ -- typeof void delete await
set bop: + - * / % ** == != === !== < > <= >= << & | ^ && || ?? in instanceof
set aop: = += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=
set gt: > >|
set lit: null true false this super
set decl: var let const
expr = assign (',' assign)*
assign = arrow | gen | cond ((aop | SHIFTSET) cond)* ((aop | SHIFTSET) (arrow | gen))?
gen = 'yield' '*'? assign?
arrow = 'async'? ARROWHEAD '=>' (C.fblock | !none assign)
cond = bin ('?' assign ':' bin)* ('?' assign ':' (arrow | gen))?
bin = unary ((bop | SHIFT) unary)* BINTAIL
unary = uop* UPRE postfix ('++' | '--')?
postfix = 'new'* primary tail* ('new' '.' name tail*)?
tail = '.' name | '?.' (name | P.args | B.arr) | P.args | B.arr | str TAIL
primary = id | num | str | lit | P.expr | B.arr | C.obj | function | class | 'import' (P.args | '.' name) | 'new' '.' name
function = 'async'? 'function' '*'? id? TP P.params RT C.fblock
named = 'async'? 'function' '*'? id TP P.params RT C.fblock | DECO ABS 'class' id TP ('extends' postfix)? IMPL C.members
class = DECO ABS 'class' id? TP ('extends' postfix)? IMPL C.members
vardecl = decl bind (',' bind)*
bind = (id | B.arr | C.obj) BT ('=' assign)?
STATEMENTStops = top+
top = stmt | import | export
import = 'import' TY (str | clause 'from' str) ('with' C.obj)? ';'
clause = id (',' (C.specs | '*' 'as' id))? | C.specs | '*' 'as' id
export = 'export' ('default' (function | class | assign ';') | vardecl ';' | named | TY C.specs ('from' str)? ';' | '*' ('as' name)? 'from' str ';' TEXP)
args = (arg (',' arg)* ','?)?
arg = '...'? assign
arr = (arg? (',' arg?)*)?
params = (param (',' param)* ','?)?
param = DECO MODS '...'? (id | B.arr | C.obj | THIS) OPT BT ('=' assign)?
for = (vardecl | expr)? ';' expr? ';' expr? | decl? (id | B.arr | C.obj | postfix) ('of' | 'in') expr
obj = (prop (',' prop)* ','?)?
prop = '...' assign | pname ':' assign | name ('=' assign)? | pmod* pname TP P.params RT C.fblock
set pmod: async get set * static
pname = name | str | num | B.arr
specs = (spec (',' spec)* ','?)?
spec = TY (name | str) ('as' (name | str))?
members = member+
member = ';' | DECO mod* pname TP P.params RT (C.fblock MBODY) | DECO mod* pname MOPT BT ('=' assign)? ';' | 'static' C.block MEMB
"""

_JS_FILL = {"ARROWHEAD": "(id | P.params)", "BINTAIL": "", "UPRE": "", " TAIL": "", "TP ": "", "RT ": "", "DECO ": "", "ABS ": "", "IMPL ": "", "BT ": "", " TSTMT": "", "TY ": "", " TEXP": "", "MODS ": "", " | THIS": "", "OPT ": "", "MBODY": "", "MOPT ": "", " MEMB": "", "(‹› ": "("}
_JS_FILL_ORDER = ["ARROWHEAD", "BINTAIL", "UPRE", " TAIL", " TSTMT", " TEXP", " | THIS", " MEMB", "MBODY", "MOPT ", "MODS ", "OPT ", "TP ", "RT ", "DECO ", "ABS ", "IMPL ", "BT ", "TY ", "(‹› "]
_TS_FILL = _JS_FILL | {
    "ARROWHEAD": "(id | tparams? P.params (':' type)?)",
    "BINTAIL": "",
    "UPRE": "('<' type gt)?",
    " TAIL": " | '!' | targs P.args | ('as' | 'satisfies') (type | 'const')",
    "TP ": "tparams? ",
    "RT ": "(':' type)? ",
    "DECO ": "deco* ",
    "ABS ": "'abstract'? ",
    "IMPL ": "targs? ('implements' type (',' type)*)? ",
    "BT ": "'!'? (':' type)? ",
    " TSTMT": " | tdecl | 'function' '*'? id tparams? P.params (':' type)? ';' | 'async' 'function' id tparams? P.params (':' type)? ';'",
    "TY ": "'type'? ",
    " TEXP": " | tdecl | '=' expr ';' | 'import' id '=' expr ';' | 'function' id tparams? P.params (':' type)? ';'",
    "MODS ": "tmod* ",
    " | THIS": " | 'this'",
    "OPT ": "'?'? ",
    "MBODY": " | ';'",
    "MOPT ": "('?' | '!')? ",
    " MEMB": " | mod* pname '?' tparams? P.params (':' type)? ';' | mod* B.types (':' type) ';' | tparams? P.params (':' type)? ';' | 'new' tparams? P.params (':' type)? ';'",
}
_TS_RULES = """
set tmod: public private protected readonly override
set tpre: keyof readonly typeof infer unique
set tname: null true false this void const undefined
type = '|'? inter (('|' | '&') inter)* ('extends' type '?' type ':' type)?
inter = tpre* tprim B.types* ('is' type)?
tprim = (id | tname) ('.' name)* targs? | str | '-'? num | C.tlit | P.type | 'abstract'? 'new'? tparams? P.params '=>' type | B.types | 'import' P.args ('.' name)* targs? | 'asserts' (id | 'this') ('is' type)?
targs = '<' type (',' type)* ','? gt
tparams = '<' tparam (',' tparam)* ','? gt
tparam = ('const' | 'in' | 'out')* id ('extends' type)? ('=' type)?
types = (telem (',' telem)* ','?)?
telem = '...'? (id '?'? ':')? type '?'? | id 'in' type ('as' type)?
deco = '@' primary tail*
tdecl = 'declare'? ('type' id tparams? '=' type ';' | 'interface' id tparams? ('extends' type (',' type)*)? C.tlit | 'const'? 'enum' id C.obj | ('namespace' | 'module') (id ('.' id)* | str) C.top | vardecl ';' | class) | 'declare' 'global' C.top | 'import' id '=' expr ';'
"""


def _fill(rules: str, fill: dict[str, str]) -> str:
    rules = rules.replace("STATEMENTS", _JS_STATEMENTS).replace("SHIFTSET", "'>|' '>|'? '>='").replace("SHIFT", "'>|' '>|'? '>'")
    for k in _JS_FILL_ORDER:
        rules = rules.replace(k, fill[k])
    return rules


_JS_KW = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum"
_JS_SOFT = "let static async await of from as get set yield"
_JS_OPS = ">| === !== == != <= << && || ?? ?. => ... ** ++ -- += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= >="

JS = Syntax(
    "js", _JS_KW, _JS_SOFT, _JS_OPS,
    _fill(_JS_RULES, _JS_FILL) + "set mod: static async get set *\n",
    {"P": ["expr", "args", "params", "for"], "B": ["arr"], "C": ["obj", "specs"]},
    {"fblock": "fstmts", "block": "stmts", "members": "members"}, "tops",
    continues="else catch finally from as in instanceof extends of", newline="keep",
)
TS = Syntax(
    "ts", _JS_KW, _JS_SOFT + " type interface namespace module declare abstract readonly public private protected implements keyof infer is satisfies override asserts unique undefined global out", _JS_OPS,
    _fill(_JS_RULES, _TS_FILL) + _TS_RULES + "set mod: static async get set * public private protected readonly override abstract declare\n",
    {"P": ["expr", "args", "params", "for", "type"], "B": ["arr", "types"], "C": ["obj", "specs"]},
    {"fblock": "fstmts", "block": "stmts", "members": "members", "tlit": "members", "top": "tops"}, "tops",
    continues="else catch finally from as in instanceof extends of implements satisfies is", newline="keep",
)

JAVA = Syntax(
    "java",
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while null true false",
    "var record sealed permits yield non when",
    ">| == != <= && || -> :: ... ++ -- += -= *= /= %= &= |= ^= << <<= >=",
    """
set prim: boolean byte char double float int long short
set lit: null true false this super
set pmod: abstract final native private protected public static strictfp synchronized transient volatile default sealed
set uop: ! ~ + - ++ --
set bop: + - * / % == != < > <= >= && || & | ^ <<
set aop: = += -= *= /= %= &= |= ^= <<=
set gt: > >|
mods = (pmod | anno | 'non' '-' 'sealed')*
anno = '@' id ('.' id)* P.annoargs?
qual = id ('.' id)*
ctype = anno* id targs? ('.' anno* id targs?)*
type = (ctype | prim) (B.empty)*
targs = '<' (targ (',' targ)*)? gt
targ = type | '?' (('extends' | 'super') type)?
tparams = '<' tparam (',' tparam)* gt
tparam = anno* id ('extends' type ('&' type)*)?
expr = lambda | cond (store cond)* (store lambda)?
store = aop | '>|' '>|'? '>='
lambda = (id | P.lparams) '->' (C.block | expr)
cond = bin ('?' expr ':' bin)* ('?' expr ':' lambda)?
bin = unary ((bop | '>|' '>|'? '>') unary | 'instanceof' 'final'? (type id? | type P.patterns))*
unary = uop* (P.type (unary1 | lambda) | postfix) ('++' | '--')*
unary1 = ('!' | '~')* (P.type unary1 | postfix)
postfix = primary tail*
tail = '.' (targs? name P.args? | 'new' id targs? P.args C.members? | 'class' | 'this' | 'super') | B.expr | '::' (id | 'new') | P.args
primary = id targs? | prim B.empty* | num | str | lit | P.expr | new | 'switch' P.expr C.block | ctype B.empty+ | 'void' '.' 'class'
new = 'new' anno* (id targs? ('.' id targs?)* | prim) (P.args C.members? | B.expr+ B.empty* | B.empty+ C.arr)
stmts = stmt+
stmt = C.block | local ';' | expr ';' | ';' | 'if' P.expr stmt ('else' stmt)? | 'for' P.for stmt | 'while' P.expr stmt | 'do' stmt 'while' P.expr ';'
  | 'switch' P.expr C.block | 'return' expr? ';' | 'throw' expr ';' | 'try' P.resources? C.block ('catch' P.catch C.block)* ('finally' C.block)?
  | 'break' id? ';' | 'continue' id? ';' | 'synchronized' P.expr C.block | id ':' stmt | 'assert' expr (':' expr)? ';' | 'yield' expr ';'
  | 'case' label (',' label)* ('when' expr)? (':' | '->' (C.block | expr ';' | 'throw' expr ';')) | 'default' (':' | '->' (C.block | expr ';' | 'throw' expr ';')) | typedecl
label = cond | type id | type P.patterns | 'default'
local = ('final' | anno)* type var (',' var)*
var = id B.empty* ('=' init)?
init = expr | C.arr
typedecl = mods ('class' id tparams? ('extends' type)? ('implements' type (',' type)*)? ('permits' type (',' type)*)? C.members | 'interface' id tparams? ('extends' type (',' type)*)? ('permits' type (',' type)*)? C.members
  | 'enum' id ('implements' type (',' type)*)? C.enum | 'record' id tparams? P.params ('implements' type (',' type)*)? C.members | '@' 'interface' id C.members)
members = member+
member = ';' | 'static'? C.block | typedecl | mods tparams? (type | 'void') id P.params B.empty* ('throws' type (',' type)*)? ('default' init)? (C.block | ';') | mods tparams? id P.params ('throws' type (',' type)*)? C.block | mods id C.block | mods type var (',' var)* ';'
enum = (const (',' const)* ','?)? (';' member*)?
const = anno* id P.args? C.members?
tops = top+
top = anno* 'package' qual ';' | 'import' 'static'? qual ('.' '*')? ';' | typedecl | ';'
args = (expr (',' expr)*)?
annoargs = (aarg (',' aarg)*)?
aarg = (id '=')? (expr | C.arr | anno)
params = (param (',' param)*)?
param = ('final' | anno)* type '...'? (id | 'this') B.empty*
lparams = params | (id (',' id)*)?
for = (local | expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)? | ('final' | anno)* type id ':' expr
catch = ('final' | anno)* type ('|' type)* id
resources = res (';' res)* ';'?
res = ('final' | anno)* type id '=' expr | postfix
patterns = (('final'? type (id | P.patterns)) (',' 'final'? type (id | P.patterns))*)?
ptype = type ('&' type)*
arr = (ainit (',' ainit)*)? ','?
ainit = init | anno
empty = anno*
""".replace("P.type", "P.ptype"),
    {"P": ["expr", "args", "params", "for", "ptype", "lparams", "catch", "resources", "annoargs", "patterns"], "B": ["expr", "empty"], "C": ["arr", "enum"]},
    {"block": "stmts", "members": "members"}, "tops", continues="else catch finally while",
)

CS = Syntax(
    "cs",
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while",
    "var async await get set init add remove where when yield record partial required global file from select let orderby ascending descending group by join on equals into nameof with not and or dynamic scoped alias",
    ">| == != <= && || => ?? ??= ?. :: ++ -- += -= *= /= %= &= |= ^= << <<= >= .. ->",
    """
set prim: bool byte char decimal double float int long object sbyte short string uint ulong ushort dynamic
set lit: null true false this base
set pmod: public private protected internal static readonly sealed abstract virtual override async extern unsafe volatile new partial required const file ref
set uop: ! ~ + - ++ -- & * await ^ ..
set bop: + - * / % == != < > <= >= && || & | ^ << ??
set aop: = += -= *= /= %= &= |= ^= <<= ??=
set gt: > >|
attrs = B.attrs*
mods = attrs pmod*
type = 'ref'? ((id | 'global' '::' id) targs? ('.' id targs?)* | prim | 'void' '*' | P.tuple) ('?' | '*' | B.dims)*
targs = '<' (attrs ('in' | 'out')? type (',' attrs ('in' | 'out')? type)*)? ','* gt
expr = low | cond (store cond)* (store low)?
low = lambda | 'throw' expr | query
store = aop | '>|' '>|'? '>='
lambda = attrs ('async' | 'static')* (id | P.lparams | type P.lparams) '=>' (C.block | expr) | 'async'? 'delegate' P.params? C.block
cond = bin ('?' ('ref'? expr) ':' ('ref'? expr))?
bin = unary ((bop | '>|' '>|'? '>') (unary | 'throw' expr) | 'is' pattern | 'as' type | 'switch' C.arms | 'with' C.obj | '..' unary?)*
pattern = pprim (('and' | 'or') pprim)*
pprim = 'not'* (relop? unary | type id? | type? P.patterns? C.pats id? | type P.patterns id? | 'var' (id | P.lparams) | P.pattern | B.listpat id?)
relop = '<' | '>' | '<=' | '>='
unary = uop* (P.type unary | postfix) ('++' | '--' | '!')*
postfix = primary tail*
tail = ('.' | '?.' | '::' | '->') name targs? | P.args | '?'? B.args | '!' | '++' | '--'
primary = id targs? | prim | num | str | lit | P.expr | P.args | new | 'typeof' P.type | 'sizeof' P.type | 'default' P.type? | 'nameof' P.args | ('checked' | 'unchecked') P.expr | 'stackalloc' type C.arr? | B.arr
new = 'new' (type? (P.args (C.obj | C.arr)? | C.obj | C.arr) | type B.args B.dims* C.arr? | B.dims+ C.arr | prim B.args C.arr?)
query = 'from' type? id 'in' expr qpart*
qpart = 'where' expr | 'select' expr | 'let' id '=' expr | 'orderby' expr ('ascending' | 'descending')? (',' expr ('ascending' | 'descending')?)* | 'from' type? id 'in' expr | 'join' type? id 'in' expr 'on' expr 'equals' expr ('into' id)? | 'group' expr 'by' expr ('into' id)? | 'into' id
stmts = stmt+
stmt = C.block | local ';' | expr ';' | ';' | 'if' P.expr stmt ('else' stmt)? | 'for' P.for stmt | 'await'? 'foreach' P.foreach stmt | 'while' P.expr stmt | 'do' stmt 'while' P.expr ';'
  | 'switch' (P.expr | P.args) C.block | 'return' 'ref'? expr? ';' | 'throw' expr? ';' | 'try' C.block ('catch' P.catch? ('when' P.expr)? C.block)* ('finally' C.block)?
  | 'break' ';' | 'continue' ';' | 'goto' ('case' expr | 'default' | id) ';' | 'lock' P.expr stmt | 'await'? 'using' (P.using stmt | local ';') | 'fixed' P.using stmt | ('checked' | 'unchecked' | 'unsafe') C.block | 'yield' ('return' expr | 'break') ';'
  | id ':' stmt | 'case' pattern ('when' expr)? ':' | 'default' ':' | lfunc
lfunc = attrs ('static' | 'async' | 'unsafe' | 'extern')* (type | 'void') id tparams? P.params where* (C.block | '=>' expr ';')
local = ('const' | 'ref' 'readonly'? | 'scoped')? (type | 'var') var (',' var)* | 'var' P.lparams '=' expr
var = id B.args? ('=' ('ref'? expr | C.arr))?
tparams = '<' attrs ('in' | 'out')? id (',' attrs ('in' | 'out')? id)* gt
where = 'where' id ':' wcon (',' wcon)*
wcon = type | 'class' '?'? | 'struct' | 'new' P.args | 'default'
typedecl = mods (('class' | 'struct' | 'interface' | 'record' ('class' | 'struct')?) id tparams? P.params? (':' type P.args? (',' type)*)? where* (C.members ';'? | ';') | 'enum' id (':' type)? C.enum ';'? | 'delegate' (type | 'void') id tparams? P.params where* ';')
members = member+
member = ';' | typedecl | mods (type | 'void') (type '.')? id tparams? P.params where* (C.block | '=>' expr ';' | ';') | mods 'event'? type (var (',' var)* ';' | (type '.')? id (C.accs ('=' expr ';')? | '=>' expr ';')) | mods id P.params (':' ('base' | 'this') P.args)? (C.block | '=>' expr ';') | '~' id P.params C.block
  | mods type (type '.')? 'this' B.params (C.accs | '=>' expr ';') | mods ('implicit' | 'explicit')? type? 'operator' (type | opname | 'true' | 'false') P.params (C.block | '=>' expr ';')
opname = bop | '>|' '>|'? '>' | uop
accs = acc*
acc = attrs ('public' | 'private' | 'protected' | 'internal' | 'readonly')* ('get' | 'set' | 'init' | 'add' | 'remove') (';' | C.block | '=>' expr ';')
tops = top+
top = ('global'? 'using' ('static' | id '=')? type ';') | 'extern' 'alias' id ';' | 'namespace' qual (';' | C.tops ';'?) | typedecl | B.attrs | stmt
qual = id ('.' id)*
args = (arg (',' arg)*)?
arg = (id ':')? ('ref' | 'in' | 'out' (type id | 'var' id)?)? expr | (id ':')? 'out' ('var' | type) (id | P.lparams)
params = (param (',' param)*)?
param = attrs ('this' | 'ref' | 'out' | 'in' | 'params' | 'scoped' | 'readonly')* type id ('=' expr)?
lparams = params | (('ref' | 'out' | 'in')? id (',' id)*)?
tuple = type id? (',' type id?)+
for = (local | expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)?
foreach = ('var' | type) (id | P.lparams) 'in' expr | P.args 'in' expr
catch = type id?
using = local | expr
attrs1 = (id ':')? type P.args? (',' type P.args?)* ','?
dims = ','*
arr = (ael (',' ael)*)? ','?
ael = '..'? expr | C.arr
obj = (init (',' init)* ','?)?
init = (id | B.args) '=' (expr | C.obj | C.arr) | expr
enum = (attrs id ('=' expr)? (',' attrs id ('=' expr)?)*)? ','?
arms = (arm (',' arm)* ','?)?
arm = pattern ('when' expr)? '=>' expr
pats = (pat (',' pat)* ','?)?
pat = id ('.' id)* ':' pattern
patterns = ((id ':')? pattern (',' (id ':')? pattern)*)?
listpat = (lp (',' lp)*)?
lp = pattern | '..' pattern?
""".replace("B.attrs", "B.attrs1").replace("tops ';'?", "tops ';'?"),
    {"P": ["expr", "args", "params", "for", "foreach", "type", "lparams", "catch", "using", "tuple", "patterns", "pattern"], "B": ["args", "attrs1", "dims", "arr", "params", "listpat"], "C": ["arr", "obj", "enum", "arms", "pats", "accs"]},
    {"block": "stmts", "members": "members", "tops": "tops"}, "tops", continues="else catch finally while when switch with get set init",
)

GO = Syntax(
    "go",
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "",
    ":= == != <= >= && || <- ... ++ -- += -= *= /= %= &= |= ^= << >> <<= >>= &^ &^=",
    """
set bop: + - * / % == != < > <= >= && || & | ^ << >> &^
set uop: ! + - * & ^ <- ~
set aop: = += -= *= /= %= &= |= ^= <<= >>= &^= :=
type = '*'* (id ('.' id)? B.types? | B.expr type | B.empty type | B.dots type | 'map' B.type type | 'chan' '<-'? type | '<-' 'chan' type | 'func' sig | 'struct' C.fields | 'interface' C.ifaces | P.type)
sig = P.params (P.params | type)?
expr = unary (bop unary)*
unary = uop* postfix
postfix = primary tail*
tail = '.' id | '.' P.type | '.' P.kwtype | P.args | B.index | B.types | C.lit
primary = id | num | str | P.expr | 'func' sig C.block | littype C.lit | type
littype = B.expr type | B.empty type | B.dots type | 'map' B.type type | 'struct' C.fields
exprs = expr (',' expr)*
simple = exprs (aop exprs | '++' | '--' | '<-' expr)? | exprs aop 'range' expr | 'range' expr
stmts = stmt+
stmt = simple ';' | ';' | C.block ';'? | decl | 'return' exprs? ';' | 'if' (simple? ';')? expr C.block else? ';'? | 'for' forhead? C.block ';'? | 'switch' (simple? ';')? simple? C.block ';'? | 'select' C.block ';'?
  | 'case' (exprs | simple | type (',' type)*) ':' | 'default' ':' | ('go' | 'defer') expr ';' | ('break' | 'continue' | 'goto') id? ';' | 'fallthrough' ';' | id ':' stmt?
else = 'else' (C.block | 'if' (simple? ';')? expr C.block else?)
forhead = simple? ';' expr? ';' simple? | simple
decl = 'var' (varspec | P.vars) ';' | 'const' (constspec | P.consts) ';' | 'type' (typespec | P.typespecs) ';'
varspec = ids (type ('=' exprs)? | '=' exprs)
constspec = ids (type? '=' exprs)?
typespec = id (B.tparams)? '='? type
ids = id (',' id)*
vars = (varspec (';' varspec)* ';'?)?
consts = (constspec (';' constspec)* ';'?)?
typespecs = (typespec (';' typespec)* ';'?)?
imports = (imp (';' imp)* ';'?)?
imp = ('.' | id)? str
tops = top+
top = 'package' id ';' | 'import' (imp | P.imports) ';' | decl | 'func' P.params? id (B.tparams)? sig (C.block)? ';' | ';'
params = (param (',' param)* ','?)?
param = ids? '...'? type
args = (arg (',' arg)* ','?)?
arg = (expr | type) '...'?
tparams = ids constraint (',' ids constraint)* ','?
constraint = '~'? type ('|' '~'? type)*
types = type (',' type)* ','?
index = expr | expr? ':' expr? (':' expr)?
dots = '...'
empty = ()
kwtype = 'type'
lit = (el (',' el)* ','?)?
el = (lval ':')? lval
lval = expr | C.lit
fields = (field (';' field)* ';'?)?
field = ids type str? | '*'? id ('.' id)? B.types? str?
ifaces = (iface (';' iface)* ';'?)?
iface = id sig | constraint
""".replace("empty = ()\n", "none =\n").replace("B.empty", "B.none"),
    {"P": ["expr", "args", "params", "type", "imports", "vars", "consts", "typespecs", "kwtype"], "B": ["expr", "index", "types", "type", "tparams", "dots", "none"], "C": ["lit", "fields", "ifaces"]},
    {"block": "stmts"}, "tops", continues="else", newline="go",
)

JSON = Syntax(
    "json", "true false null", "", "",
    """
value = str | num | 'true' | 'false' | 'null' | B.items | C.pairs
items = (value (',' value)*)?
pairs = (str ':' value (',' str ':' value)*)?
""",
    {"P": [], "B": ["items"], "C": ["pairs"]}, {}, "value",
)

PY = Syntax(
    "py",
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "match case type _",
    "== != <= >= << >> ** // -> := += -= *= /= //= %= @= &= |= ^= >>= <<= **= ...",
    """
set bop: + - * / % ** // << >> & | ^ @ == != < > <= >= in is and or
set lit: None True False ...
set aop: += -= *= /= //= %= @= &= |= ^= >>= <<= **=
expr = lambda | or ('if' or 'else' or)* ('if' or 'else' lambda)?
or = not (bop 'not'? not)*
not = ('not' | '-' | '+' | '~' | 'await')* postfix
bin = 'not'* not
postfix = primary tail*
tail = '.' id | P.args | B.subs
primary = id | num | str+ | lit | P.inner | B.elems | C.dict
lambda = 'lambda' lparams? ':' expr
lparams = lparam (',' lparam)* ','?
lparam = ('*' | '**')? id ('=' expr)? | '*' | '/'
star = '*' or | named
named = (id ':=')? expr
stars = star (',' star)* ','?
yield = 'yield' ('from' expr | stars)?
comp = 'async'? 'for' targets 'in' or ('if' or1)* 
or1 = lambda | or
comps = (comp)+
targets = target (',' target)* ','?
target = '*'? postfix
inner = (yield | stars | named comps)?
args = (arg (',' arg)* ','?)? | named comps
arg = '*' expr | '**' expr | id '=' expr | named
subs = sub (',' sub)* ','?
sub = '*' or | named | expr? ':' expr? (':' expr?)?
elems = (stars | star comps)?
dict = (ditem (',' ditem)* ','?)? | expr ':' expr comps | star comps
ditem = expr ':' expr | '**' or | star
params = (param (',' param)* ','?)?
param = ('*' | '**')? id (':' star)? ('=' expr)? | '*' | '/'
tparams = ('*' | '**')? id (':' expr)? ('=' expr)? (',' ('*' | '**')? id (':' expr)? ('=' expr)?)* ','?
line = small (';' small)* ';'?
small = assign | 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' (expr ('from' expr)?)? | 'global' id (',' id)* | 'nonlocal' id (',' id)* | 'del' targets | 'assert' expr (',' expr)? | import | 'type' id B.tparams? '=' expr
assign = stars ('=' (yield | stars))* | yield | postfix ':' expr ('=' (yield | stars))? | postfix aop (yield | stars)
import = 'import' dotted ('as' id)? (',' dotted ('as' id)?)* | 'from' ('.' | '...')* dotted? 'import' ('*' | P.names | names1)
dotted = id ('.' id)*
names1 = id ('as' id)? (',' id ('as' id)?)*
names = names1 ','?
head_def = 'async'? 'def' id B.tparams? P.params ('->' expr)? ':'
head_class = 'class' id B.tparams? P.args? ':'
head_if = 'if' named ':'
head_elif = 'elif' named ':'
head_else = 'else' ':'
head_for = 'async'? 'for' targets 'in' stars ':'
head_while = 'while' named ':'
head_try = 'try' ':'
head_except = 'except' '*'? (expr ('as' id | (',' expr)+)?)? ':'
head_finally = 'finally' ':'
head_with = 'async'? 'with' (withitem (',' withitem)* | P.withs) ':'
withitem = expr ('as' target)?
withs = withitem (',' withitem)* ','?
head_match = 'match' stars ':'
head_case = 'case' pats ('if' named)? ':'
pats = pat (',' pat)* ','?
pat = orpat ('as' id)? | '*' id
orpat = ppat ('|' ppat)*
ppat = '-'? num (('+' | '-') num)? | str+ | lit | id ('.' id)* P.pargs? | P.ppats | B.ppats | C.dpats
ppats = (pats)?
pargs = ((id '=')? pat (',' (id '=')? pat)* ','?)?
dpats = (dpat (',' dpat)* ','?)?
dpat = '**' id | ('-'? num | str | lit | id ('.' id)*) ':' pat
deco = '@' named
""",
    {"P": ["inner", "args", "params", "names", "withs", "ppats", "pargs"], "B": ["subs", "elems", "tparams", "ppats"], "C": ["dict", "dpats"]}, {}, "line",
)

SYNTAXES = {s.name: s for s in (JS, TS, JAVA, CS, GO, JSON, PY)}
_built: dict[str, Syntax] = {}


def syntax(name: str) -> Syntax:
    if name not in _built:
        _built[name] = SYNTAXES[name].build()
    return _built[name]
