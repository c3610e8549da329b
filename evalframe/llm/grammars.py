"""Token rules and grammars of the three languages, in the notation of ``derivatives``."""

from __future__ import annotations

import re
from collections.abc import Callable

from evalframe.llm.derivatives import Grammar

CPP = r"""
unit = ext*
ext = ';' | 'namespace' (NAME ('::' NAME)*)? '{' ext* '}' | 'inline' 'namespace' NAME '{' ext* '}' | 'extern' STRING ( '{' ext* '}' | ext ) | 'template' '<' tparams? '>' ext
  | using | typedef | decl | function | attr ext | 'static_assert' '(' args ')' ';' | 'namespace' NAME '=' qname ';' | 'template' decl
attr = '[' '[' attrtok* ']' ']'
attrtok = NAME | '::' | ',' | '(' attrtok* ')' | NUMBER | STRING
tparams = tparam ( ',' tparam )*
tparam = ( 'typename' | 'class' ) '...'? NAME? ( '=' type )? | type '...'? NAME? ( '=' tvalue )? | 'template' '<' tparams '>' ( 'class' | 'typename' ) NAME?
using = 'using' 'namespace' qname ';' | 'using' 'typename'? qname ( ',' qname )* ';' | 'using' NAME attr? '=' type ';' | 'using' 'enum' qname ';'
typedef = 'typedef' spec initlist ';'
cv = 'const' | 'volatile' | 'constexpr' | 'static' | 'inline' | 'register' | 'extern' | 'mutable' | 'thread_local' | 'virtual' | 'explicit' | 'friend' | 'consteval' | 'constinit'
basic = 'int' | 'long' | 'short' | 'char' | 'bool' | 'double' | 'float' | 'void' | 'unsigned' | 'signed' | 'wchar_t' | 'char16_t' | 'char32_t' | 'char8_t'
base = basic ( basic | cv )* | 'auto' | 'decltype' '(' expr ')' | qname | 'typename' qname | ( 'struct' | 'class' | 'union' | 'enum' ) qname
spec = ( cv | attr )* base cv*
qname = '::'? part ( '::' 'template'? part )* ( '::' '~' NAME )? ( '::' 'operator' oper )?
part = NAME targs?
targs = '<' ( targ ( ',' targ )* )? '>'
targ = type '...'? | tvalue
tvalue = toperand ( tbin toperand )*
tbin = '+' | '-' | '*' | '/' | '%' | '<<' | '&' | '|' | '^' | '&&' | '||' | '==' | '!=' | '<=' | '>=' | '?' | ':'
toperand = ( '-' | '+' | '!' | '~' | '&' )* ( NUMBER | CHAR | STRING+ | 'true' | 'false' | 'nullptr' | qname | '(' expr ')' | 'sizeof' '(' type ')' ) ( '(' args? ')' | braced )*
ptr = '*' cv* | '&' | '&&' | qname '::' '*'
type = spec ptr* ( '[' expr? ']' )* ( '(' params? ')' cv* 'noexcept'? )? | spec '(' ptr+ ')' '(' params? ')' | spec ptr* '(' ptr ')' ( '[' expr? ']' )+
params = param ( ',' param )* ( ',' '...' )? | '...' | 'void'
param = attr? spec ptr* '...'? pname? ( '=' initval )?
pname = NAME ( '[' expr? ']' )* | '(' ptr* NAME? ')' ( '[' expr? ']' | '(' params? ')' )+ | '[' expr? ']' | NAME '(' params? ')' | '(' params? ')'
declarator = ptr* direct
direct = ( qname | 'operator' oper | '(' ptr+ direct? ')' | '(' direct ')' ) ( '[' expr? ']' | '(' params? ')' quals )* attr?
fdeclarator = ptr* ( qname | 'operator' oper | '(' ptr+ direct? ')' | '(' direct ')' ) ( '[' expr? ']' )* '(' params? ')' quals ( '[' expr? ']' | '(' params? ')' quals )* attr?
quals = ( 'const' | 'volatile' | '&' | '&&' | 'noexcept' ( '(' expr ')' )? | 'override' | 'final' | 'throw' '(' ')' )* ( '->' type )?
oper = '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '~' | '!' | '=' | '<' | '>' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<' | '>' '>' | '<<=' | '>' '>=' | '==' | '!=' | '<=' | '>=' | '<=>' | '&&' | '||' | '++' | '--' | ',' | '->*' | '->' | '(' ')' | '[' ']' | 'new' | 'delete' | 'new' '[' ']' | 'delete' '[' ']' | STRING NAME | type
initval = assign | braced
braced = '{' ( initclause ( ',' initclause )* ','? )? '}'
initclause = initval '...'? | '.' NAME ( '=' initval | braced )
init = '=' initval | '(' args ')' | braced
initdecl = declarator init? | declarator ':' assign | ':' assign
initlist = initdecl ( ',' initdecl )*
decl = spec initlist ';' | classdef initlist? ';' | cv+ classdef initlist ';' | enumdef initlist? ';' | spec ';' | spec ( '&' | '&&' )? '[' NAME ( ',' NAME )* ']' init ';'
classdef = ( 'struct' | 'class' | 'union' ) attr? ( qname 'final'? )? ( ':' bases )? '{' member* '}'
bases = ( 'public' | 'private' | 'protected' | 'virtual' )* qname '...'? ( ',' ( 'public' | 'private' | 'protected' | 'virtual' )* qname '...'? )*
enumdef = 'enum' ( 'class' | 'struct' )? qname? ( ':' type )? '{' ( enumerator ( ',' enumerator )* ','? )? '}'
enumerator = NAME ( '=' assign )?
member = ( 'public' | 'private' | 'protected' ) ':' | ';' | using | typedef | decl | function | 'template' '<' tparams? '>' member | 'static_assert' '(' args ')' ';' | cv* '~' NAME '(' ')' quals ( block | ';' | '=' ( 'default' | 'delete' | NUMBER ) ';' )
  | cv* NAME '(' params? ')' quals ctorinit? ( block | ';' | '=' ( 'default' | 'delete' ) ';' ) | cv* 'operator' oper '(' params? ')' quals ( block | ';' ) | 'friend' decl | 'friend' function
function = spec? fdeclarator ctorinit? ( block | tryblock | '=' ( 'default' | 'delete' | NUMBER ) ';' ) | cv+ fdeclarator ctorinit? block
  | spec? qname '(' params? ')' quals ctorinit? block
ctorinit = ':' meminit ( ',' meminit )*
meminit = qname ( '(' args? ')' | braced ) '...'?
block = '{' stmt* '}'
tryblock = 'try' block ( 'catch' '(' ( param | '...' ) ')' block )+
stmt = ';' | block | expr ';' | decl | using | typedef | attr stmt | 'static_assert' '(' args ')' ';'
  | 'if' 'constexpr'? '(' stmtinit? cond ')' stmt ( 'else' stmt )? | 'while' '(' cond ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'switch' '(' stmtinit? cond ')' stmt
  | 'for' '(' ( decl | expr? ';' ) cond? ';' expr? ')' stmt | 'for' '(' stmtinit? spec ptr* ( NAME | '[' NAME ( ',' NAME )* ']' ) ':' initval ')' stmt
  | 'return' ( expr | braced )? ';' | 'break' ';' | 'continue' ';' | 'goto' NAME ';' | NAME ':' stmt? | 'case' expr ( '...' expr )? ':' stmt? | 'default' ':' stmt? | tryblock | 'throw' expr? ';' | 'asm' '(' args ')' ';' | 'co_return' expr? ';'
stmtinit = decl | expr ';' | ';'
cond = expr | spec declarator ( '=' initval | braced )
args = arg ( ',' arg )*
arg = ( assign | braced ) '...'?
expr = assign ( ',' assign )*
assign = operand ( binop ( operand | braced ) | '?' expr? ':' operand )* | 'throw' assign?
binop = '+' | '-' | '*' | '/' | '%' | '<<' | '>' '>' | '<' | '>' | '<=' | '>=' | '<=>' | '==' | '!=' | '&' | '|' | '^' | '&&' | '||' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '.*' | '->*' | 'and' | 'or' | 'xor' | 'bitand' | 'bitor'
prefix = '+' | '-' | '!' | '~' | '*' | '&' | '++' | '--' | '&&' | 'not' | 'compl' | '(' type ')' | 'sizeof' | 'co_await'
operand = prefix* ( primary postfix* | newexpr postfix* | 'delete' ( '[' ']' )? operand | 'sizeof' '(' type ')' | 'sizeof' '...' '(' NAME ')' | 'noexcept' '(' expr ')' | 'typeid' '(' ( expr | type ) ')' | 'alignof' '(' type ')' )
newexpr = '::'? 'new' ( '(' args ')' )? ( spec ptr* ( '[' expr ']' )* | '(' type ')' ) ( '(' args? ')' | braced )?
primary = NUMBER | STRING+ | CHAR | 'true' | 'false' | 'nullptr' | 'this' | qname | '(' expr ')' | '(' foldpart ')' | '(' block ')' | lambda | basic+ ( '(' args? ')' | braced ) | 'typename' qname ( '(' args? ')' | braced ) | casting '<' type '>' '(' expr ')' | 'decltype' '(' expr ')' ( '(' args? ')' | braced ) | 'operator' oper
foldpart = operand binop '...' ( binop operand )? | '...' binop operand
casting = 'static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast'
postfix = '[' ( expr | braced )? ']' | '(' args? ')' | ( '.' | '->' ) 'template'? ( qname | '~' NAME | 'operator' oper ) | '++' | '--' | braced
lambda = '[' captures? ']' ( '<' tparams '>' )? ( '(' params? ')' )? ( 'mutable' | 'constexpr' | 'noexcept' ( '(' expr ')' )? )* attr? ( '->' type )? block
captures = capture ( ',' capture )*
capture = '&' | '=' | '&'? '...'? NAME '...'? ( '=' initval )? | '*'? 'this' | '&'? NAME ( '(' args ')' | braced )
"""

JAVA = r"""
unit = ( annots 'package' name ';' )? ( 'import' 'static'? name ( '.' '*' )? ';' | ';' )* ( typedecl | ';' )*
name = NAME ( '.' NAME )*
annots = annot*
annot = '@' name ( '(' ( annval ( ',' annval )* | NAME '=' annval ( ',' NAME '=' annval )* )? ')' )?
annval = expr | annot | '{' ( annval ( ',' annval )* ','? )? '}'
mods = ( annot | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non-sealed' )*
typedecl = mods ( classdecl | enumdecl | interfacedecl | recorddecl | '@' interfacedecl )
classdecl = 'class' NAME tparams? ( 'extends' type )? ( 'implements' types )? ( 'permits' types )? classbody
recorddecl = 'record' NAME tparams? '(' params? ')' ( 'implements' types )? classbody
interfacedecl = 'interface' NAME tparams? ( 'extends' types )? ( 'permits' types )? classbody
enumdecl = 'enum' NAME ( 'implements' types )? '{' ( econst ( ',' econst )* )? ','? ( ';' member* )? '}'
econst = annots NAME ( '(' args? ')' )? classbody?
types = type ( ',' type )*
tparams = '<' tparam ( ',' tparam )* '>'
tparam = annots NAME ( 'extends' type ( '&' type )* )?
classbody = '{' member* '}'
member = ';' | 'static'? block | mods tparams? ( type | 'void' ) NAME '(' params? ')' dims ( 'throws' types )? ( block | ';' | 'default' annval ';' ) | mods tparams? NAME '(' params? ')' ( 'throws' types )? block | mods NAME block | mods type vars ';' | typedecl
params = param ( ',' param )*
param = mods type '...'? ( NAME | 'this' ) dims
dims = ( annots '[' ']' )*
prim = 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'double' | 'float'
type = annots ( prim | NAME targs? ( '.' NAME targs? )* ) dims
targs = '<' ( targ ( ',' targ )* )? '>'
targ = type | annots '?' ( ( 'extends' | 'super' ) type )?
vars = var ( ',' var )*
var = NAME dims ( '=' ( expr | arrayinit ) )?
arrayinit = '{' ( ( expr | arrayinit ) ( ',' ( expr | arrayinit ) )* ','? )? '}'
block = '{' stmt* '}'
localvar = ( annot | 'final' )* type vars
stmt = ';' | block | localvar ';' | typedecl | doing ';' | 'if' '(' expr ')' stmt ( 'else' stmt )? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' ( localvar | doing ( ',' doing )* )? ';' expr? ';' ( doing ( ',' doing )* )? ')' stmt | 'for' '(' ( annot | 'final' )* type NAME ':' expr ')' stmt
  | 'return' expr? ';' | 'break' NAME? ';' | 'continue' NAME? ';' | 'throw' expr ';' | 'yield' expr ';' | NAME ':' stmt | 'assert' expr ( ':' expr )? ';' | 'synchronized' '(' expr ')' block
  | 'switch' '(' expr ')' switchbody | 'try' resources block ( 'catch' '(' mods type ( '|' type )* NAME ')' block )* ( 'finally' block )? | 'try' block ( ( 'catch' '(' mods type ( '|' type )* NAME ')' block )+ ( 'finally' block )? | 'finally' block )
doing = primary post* ( '(' args? ')' | '++' | '--' | assignop expr ) | ( '++' | '--' ) unary | newexpr
resources = '(' resource ( ';' resource )* ';'? ')'
resource = mods type NAME '=' expr | expr
switchbody = '{' ( ( 'case' label ( ',' label )* | 'default' ) ( ':' stmt* | '->' ( expr ';' | block | 'throw' expr ';' ) ) )* '}'
label = tern | 'default' | type NAME ( 'when' expr )? | type '(' ( pattern ( ',' pattern )* )? ')'
pattern = type NAME | type '(' ( pattern ( ',' pattern )* )? ')'
expr = tern ( assignop ( tern | lambda ) )* | lambda
assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='
tern = binary ( '?' expr ':' ( lambda | tern ) )?
binary = unary ( binop unary | 'instanceof' ( 'final'? type NAME? | pattern ) )*
binop = '+' | '-' | '*' | '/' | '%' | '<<' | '>' '>' | '>' '>' '>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&' | '|' | '^' | '&&' | '||'
unary = ( '+' | '-' | '!' | '~' | '++' | '--' | '(' type ( '&' type )* ')' )* ( primary post* | castlambda )
castlambda = '(' type ')' lambda
lambda = ( NAME | '(' ( NAME ( ',' NAME )* | params )? ')' ) '->' ( expr | block )
primary = NUMBER | STRING | CHAR | 'true' | 'false' | 'null' | 'this' | 'super' | NAME | '(' expr ')' | newexpr | type '::' ( targs? ( NAME | 'new' ) ) | prim dims '.' 'class' | 'void' '.' 'class' | NAME dims '.' 'class' | 'switch' '(' expr ')' switchbody
post = '.' ( targs? NAME | 'this' | 'super' | 'class' | newexpr ) | '[' expr ']' | '(' args? ')' | '++' | '--' | '::' targs? ( NAME | 'new' )
args = expr ( ',' expr )*
newexpr = 'new' annots ( prim | NAME targs? ( '.' NAME targs? )* ) ( '(' args? ')' classbody? | ( '[' expr ']' )+ dims | ( '[' ']' )+ arrayinit )
"""

PYTHON = r"""
unit = ( NEWLINE | stmt )*
stmt = simple | compound
simple = small ( ';' small )* ';'? NEWLINE
small = exprstmt | 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' ( test ( 'from' test )? )? | 'del' dlist | 'global' NAME ( ',' NAME )* | 'nonlocal' NAME ( ',' NAME )* | 'assert' test ( ',' test )? | importing | 'type' NAME tparams? '=' test
importing = 'import' dotted ( 'as' NAME )? ( ',' dotted ( 'as' NAME )? )* | 'from' ( ( '.' | '...' )* dotted | ( '.' | '...' )+ ) 'import' ( '*' | '(' imports ','? ')' | imports )
imports = NAME ( 'as' NAME )? ( ',' NAME ( 'as' NAME )? )*
dotted = NAME ( '.' NAME )*
exprstmt = stars | yielding | single ( ':' test ( '=' ( stars | yielding ) )? | augop ( stars | yielding ) ) | ( tlist '=' )+ ( stars | yielding )
place = atom trailer* ( '.' NAME | '[' subs ']' )
single = NAME | '(' single ')' | place
tlist = tstar ( ',' tstar )* ','?
tstar = '*'? tgt
tgt = NAME | '(' tlist? ')' | '[' tlist? ']' | place
dlist = dtgt ( ',' dtgt )* ','?
dtgt = NAME | '(' dlist? ')' | '[' dlist? ']' | place
augop = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
yielding = 'yield' ( 'from' test | stars? )
stars = star ( ',' star )* ','?
star = '*' bitor | test
compound = 'if' named ':' suite ( 'elif' named ':' suite )* ( 'else' ':' suite )? | 'while' named ':' suite ( 'else' ':' suite )? | 'async'? 'for' tlist 'in' stars ':' suite ( 'else' ':' suite )?
  | 'try' ':' suite ( ( 'except' ( '*'? test ( 'as' NAME )? )? ':' suite )+ ( 'else' ':' suite )? ( 'finally' ':' suite )? | 'finally' ':' suite )
  | 'async'? 'with' ( withitem ( ',' withitem )* | '(' withitem ( ',' withitem )* ','? ')' ) ':' suite | ( '@' named NEWLINE )* ( 'async'? 'def' NAME tparams? '(' params? ')' ( '->' test )? ':' suite | 'class' NAME tparams? ( '(' args? ')' )? ':' suite )
  | 'match' stars ':' NEWLINE INDENT ( 'case' patterns ( 'if' named )? ':' suite )+ DEDENT
tparams = '[' tparam ( ',' tparam )* ','? ']'
tparam = ( '*' | '**' )? NAME ( ':' test )? ( '=' test )?
withitem = test ( 'as' tgt )?
suite = simple | NEWLINE INDENT stmt+ DEDENT
params = ( ppos ( ',' pkw )? | pkw ) ','?
ppos = p ( ',' p )* ( ',' '/' ( ',' p )* )? ( ',' pd )* | p ( ',' p )* ( ',' pd )+ ',' '/' ( ',' pd )* | pd ( ',' pd )* ( ',' '/' ( ',' pd )* )?
p = NAME ( ':' test )?
pd = NAME ( ':' test )? '=' test
pkw = '*' NAME ( ':' star )? ( ',' ( p | pd ) )* ( ',' '**' p )? | '*' ( ',' ( p | pd ) )+ ( ',' '**' p )? | '**' p
patterns = pattern ( ',' pattern )* ','?
pattern = '*' NAME | orpat ( 'as' NAME )?
orpat = closed ( '|' closed )*
closed = '-'? NUMBER ( ( '+' | '-' ) NUMBER )? | STRING+ | 'None' | 'True' | 'False' | dotted ( '(' ( patarg ( ',' patarg )* ','? )? ')' )? | '(' patterns? ')' | '[' patterns? ']' | '{' ( mappat ( ',' mappat )* ','? )? '}'
patarg = ( NAME '=' )? pattern
mappat = ( '-'? NUMBER | STRING+ | dotted | 'None' | 'True' | 'False' ) ':' pattern | '**' NAME
named = ( NAME ':=' )? test
test = ortest ( 'if' ortest 'else' test )? | 'lambda' lparams? ':' test
lparams = ( lpos ( ',' lkw )? | lkw ) ','?
lpos = NAME ( ',' NAME )* ( ',' '/' ( ',' NAME )* )? ( ',' ld )* | NAME ( ',' NAME )* ( ',' ld )+ ',' '/' ( ',' ld )* | ld ( ',' ld )* ( ',' '/' ( ',' ld )* )?
ld = NAME '=' test
lkw = '*' NAME ( ',' ( NAME | ld ) )* ( ',' '**' NAME )? | '*' ( ',' ( NAME | ld ) )+ ( ',' '**' NAME )? | '**' NAME
ortest = nottest ( ( 'or' | 'and' ) nottest )*
nottest = 'not'* bitor ( compop bitor )*
compop = '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'?
bitor = factor ( binop factor )*
binop = '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '%' | '//' | '@' | '**'
factor = ( '+' | '-' | '~' | 'await' )* atom trailer*
trailer = '(' args? ')' | '[' subs ']' | '.' NAME
subs = sub ( ',' sub )* ','?
sub = named | '*' bitor | test? ':' test? ( ':' test? )?
args = named comp+ | ( parg ( ',' parg )* ( ',' kwargs )? | kwargs ) ','?
parg = named | '*' test
kwargs = ks ( ',' ks )* ( ',' kd )* | kd ( ',' kd )*
ks = NAME '=' test | '*' test
kd = NAME '=' test | '**' test
comp = 'async'? 'for' tlist 'in' ortest ( 'if' condtest )*
condtest = ( NAME ':=' )? ortest | 'lambda' lparams? ':' condtest
atom = NAME | NUMBER | STRING+ | 'None' | 'True' | 'False' | '...' | '(' ( yielding | group )? ')' | '[' group? ']' | '{' ( dictpart ( ',' dictpart )* ','? | test ':' test comp+ | group )? '}'
group = element comp* | element ( ',' element )+ ','? | element ','
element = '*' bitor | named
dictpart = test ':' test | '**' bitor
"""

_CPP_TOKEN = re.compile(
    r"""(?P<skip>[ \t\f\v]+|\\\r?\n|//(?:\\\r?\n|[^\n])*|/\*.*?\*/)|(?P<line>\r?\n|\r)"""
    r"""|(?P<STRING>(?:u8|[uUL])?(?:R"(?P<d>[^\s()\\"]{0,16})\(.*?\)(?P=d)"|"(?:[^"\\\r\n]|\\(?:\r\n|.))*")(?:_\w+|s|sv)?)"""
    r"""|(?P<CHAR>(?:u8|[uUL])?'(?:[^'\\\r\n]|\\.)+')|(?P<NUMBER>\.?\d(?:'?[\w.]|(?<=[eEpP])[+\-])*)|(?P<NAME>[^\W\d]\w*)"""
    r"""|(?P<op>\.\.\.|<=>|->\*|<<=|>=|<=|<<|->|\.\*|\+\+|--|&&|\|\||==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|::|[-+*/%<>=!&|^~?:;,.(){}\[\]])""",
    re.S,
)
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(?:(?:include|define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|warning|line)\b(?:\\\r?\n|/\*.*?\*/|[^\n])*|(?=\r?\n|\Z))", re.S)
_JAVA_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n\r]*|/\*.*?\*/)|(?P<STRING>\"{3}[ \t\f]*\r?\n(?:[^\\]|\\.)*?\"{3}|"(?:[^"\\\r\n]|\\(?:[btnfrs"'\\0-7]|u+[0-9a-fA-F]{4}))*")|(?P<CHAR>'(?:[^'\\\r\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\[btnfrs"'\\])')"""
    r"""|(?P<NUMBER>(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+\-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+\-]?\d+)?)[lLfFdD]?(?!\w))|(?P<NAME>[^\W\d][\w$]*|\$[\w$]*)"""
    r"""|(?P<op>\.\.\.|<<=|>=|<=|<<|->|::|\+\+|--|&&|\|\||==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%<>=!&|^~?:;,.(){}\[\]@])""",
    re.S,
)
_PY_STRING = r"""(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?(?:'{3}(?:[^\\]|\\.)*?'{3}|"{3}(?:[^\\]|\\.)*?"{3}|'(?:[^'\\\r\n]|\\(?:\r\n|.))*'|"(?:[^"\\\r\n]|\\(?:\r\n|.))*")"""
_PY_TOKEN = re.compile(
    rf"""(?P<skip>[ \t\f]+|\\\r?\n|#[^\r\n]*)|(?P<line>\r\n|\r|\n)|(?P<STRING>{_PY_STRING})"""
    r"""|(?P<NUMBER>(?:0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+\-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+\-]?\d(?:_?\d)*)?[jJ]?))|(?P<NAME>[^\W\d]\w*)"""
    r"""|(?P<op>\.\.\.|\*\*=|//=|>>=|<<=|\*\*|//|>>|<<|<=|>=|==|!=|->|:=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@<>=&|^~:;,.(){}\[\]])""",
    re.S,
)
#: escapes that no string may hold, in text and in bytes
_PY_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![\da-fA-F]{2})|u(?![\da-fA-F]{4})|U(?!(?:000[\da-fA-F]|0010)[\da-fA-F]{4})|N(?!\{[^}]+\}))")
_PY_BAD_BYTES = re.compile(r"(?<!\\)(?:\\\\)*\\x(?![\da-fA-F]{2})")
_PY_NUMBER_THEN = re.compile(r"(?:and|else|for|if|in|is|or|not)\b")
#: words that only the grammar of some places treats as keywords
_SOFT = {"match", "case", "type", "override", "final", "record", "sealed", "permits", "yield", "when"}


class Language:
    """A grammar, its words and a function from source text to token kinds."""

    def __init__(self, grammar: str, lex: Callable[[str, dict[str, int]], list[tuple[int, int]]], soft: set[str]) -> None:
        self.grammar = Grammar(grammar, "unit")
        kinds = self.grammar.kinds
        self.error = kinds.setdefault("ERROR", len(kinds))
        self.words = {w: k for w, k in kinds.items() if re.fullmatch(r"[a-z]\w*|None|True|False", w) and w not in soft}
        self.kinds, self._lex, self.soft = kinds, lex, {w: kinds[w] for w in soft if w in kinds}

    def failure(self, code: str) -> tuple[int, bool] | None:
        """None if the text parses, else (offset of the failing token, whether the text merely breaks off).

        Soft keywords are tried as names first and as keywords where a name cannot stand.
        """
        tokens = self._lex(code, self)
        g = self.grammar
        if not self.soft:
            at = g.failure([k for k, _ in tokens])
        else:
            at = self._soft_failure(tokens, code)
        if at is None:
            return None
        return (tokens[at][1], False) if at < len(tokens) else (len(code), True)

    def _soft_failure(self, tokens: list[tuple[int, int]], code: str) -> int | None:
        """As Grammar.failure, where a soft keyword may be read both ways: the two states run side by side."""
        g, name = self.grammar, self.kinds["NAME"]
        if len(g.moves) > 1 << 20:
            g.reset()
        states = {g.start}
        moves = g.moves
        for i, (kind, at) in enumerate(tokens):
            read = (kind,)
            if kind == name:
                word = next((w for w in self.soft if code.startswith(w, at) and not code[at + len(w) : at + len(w) + 1].isidentifier()), None) if code[at] in self._initials else None
                if word:
                    read = (kind, self.soft[word])
            after = set()
            for s in states:
                for k in read:
                    n = moves.get((s, k))
                    after.add(g.derive(s, k) if n is None else n)
            after.discard(g.dead)
            if not after:
                return i
            states = after
        return None if any(g.accepts_end(s) for s in states) else len(tokens)

    @property
    def _initials(self) -> set[str]:
        if not hasattr(self, "_first_letters"):
            self._first_letters = {w[0] for w in self.soft}
        return self._first_letters


def _plain_lex(pattern: re.Pattern, directives: bool):
    def lex(code: str, lang: Language) -> list[tuple[int, int]]:
        kinds, words, error = lang.kinds, lang.words, lang.error
        out, at, size, fresh = [], 0, len(code), True
        name, match = kinds["NAME"], pattern.match
        if code.startswith("﻿"):
            at = 1
        while at < size:
            if directives and fresh and (d := _DIRECTIVE.match(code, at)) and "#" in d[0]:
                at = d.end()
                fresh = False
                continue
            m = match(code, at)
            if m is None:
                out.append((error, at))
                return out
            group = m.lastgroup
            if group == "line":
                fresh = True
            elif group == "skip":
                pass
            else:
                fresh = False
                if group == "NAME":
                    out.append((words.get(m[0], name), at))
                elif group == "op":
                    out.append((kinds.get(m[0], error), at))
                else:
                    out.append((kinds["STRING" if group in ("STRING", "d") else group], at))
            at = m.end()
        return out
    return lex


def _bad_string(token: str) -> bool:
    """A literal whose escapes, or whose characters if it is of bytes, Python refuses. Fields of f-strings are not looked into."""
    prefix = token[: min(token.find("'") % len(token), token.find('"') % len(token))].lower()
    if "b" in prefix:
        return not token.isascii() or "r" not in prefix and "\\x" in token and bool(_PY_BAD_BYTES.search(token))
    return "\\" in token and "r" not in prefix and bool(_PY_BAD_ESCAPE.search(token))


def _python_lex(code: str, lang: Language) -> list[tuple[int, int]]:
    """Python's tokens with NEWLINE, INDENT and DEDENT; mixed tabs and blanks that Python refuses are an error."""
    kinds, words, error = lang.kinds, lang.words, lang.error
    out: list[tuple[int, int]] = []
    name, newline, indent, dedent = kinds["NAME"], kinds["NEWLINE"], kinds["INDENT"], kinds["DEDENT"]
    levels, depth, at, size, fresh = [(0, 0)], 0, 0, len(code), True
    if code.startswith("﻿"):
        at = 1
    if "\0" in code:
        return [(error, code.index("\0"))]
    match = _PY_TOKEN.match
    while at < size:
        if fresh and not depth:
            col = alt = 0
            begin = at
            while at < size and code[at] in " \t\f":
                c = code[at]
                col, alt = (col + 1, alt + 1) if c == " " else ((col // 8 + 1) * 8, alt + 1) if c == "\t" else (0, 0)
                at += 1
            if at >= size:
                break
            if code[at] not in "#\r\n" and not (code[at] == "\\" and code[at + 1 : at + 2] in "\r\n"):
                if col == levels[-1][0]:
                    if alt != levels[-1][1]:
                        return [*out, (error, begin)]
                elif col > levels[-1][0]:
                    if alt <= levels[-1][1]:
                        return [*out, (error, begin)]
                    levels.append((col, alt))
                    out.append((indent, at))
                else:
                    while col < levels[-1][0]:
                        levels.pop()
                        out.append((dedent, at))
                    if (col, alt) != levels[-1]:
                        return [*out, (error, begin)]
            fresh = False
        m = match(code, at)
        if m is None:
            return [*out, (error, at)]
        group = m.lastgroup
        if group == "line":
            if not depth:
                if out and out[-1][0] not in (newline, indent, dedent):
                    out.append((newline, at))
                fresh = True
        elif group == "NAME":
            out.append((words.get(m[0], name), at))
        elif group == "op":
            op = m[0]
            depth += (op in "([{") - (op in ")]}")
            depth = max(depth, 0)
            out.append((kinds.get(op, error), at))
        elif group == "NUMBER":
            end = m.end()
            if end < size and (code[end].isalnum() or code[end] == "_") and not _PY_NUMBER_THEN.match(code, end):
                return [*out, (error, at)]
            out.append((kinds["NUMBER"], at))
        elif group == "STRING":
            if _bad_string(m[0]):
                return [*out, (error, at)]
            out.append((kinds["STRING"], at))
        at = m.end()
    if out and out[-1][0] not in (newline, dedent):
        out.append((newline, size))
    out += [(dedent, size)] * (len(levels) - 1)
    return out


_DEFINE = re.compile(r"[ \t]*#[ \t]*define[ \t]+([^\W\d]\w*)(\(([^()]*)\))?(.*)", re.S)
_SPLICE = re.compile(r"\\\r?\n")
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_WORD = re.compile(r"[ \t]*#[ \t]*(\w+)?(.*)", re.S)
_INCLUDE = re.compile(r"\s*(?:<[^<>\n]+>|\"[^\"\n]+\"|[^\W\d]\w*.*)\s*\Z", re.S)
#: what macros may unfold to in one file, in tokens
UNFOLDED = 1 << 20


def _holds(condition: str, macros: dict) -> bool:
    """Whether a branch of #if is read: numbers, defined() and known macros decide, anything else holds."""
    c = re.sub(r"defined\s*(?:\(\s*(\w+)\s*\)|(\w+))", lambda m: str(int((m[1] or m[2]) in macros)), condition).strip()
    m = re.fullmatch(r"(!?)\s*(\d+)[uUlL]*", c)
    if m:
        return bool(int(m[2])) != bool(m[1])
    return not (re.fullmatch(r"[^\W\d]\w*", c) and c not in macros)


def _cpp_lex(code: str, lang: Language) -> list[tuple[int, int]]:
    """Tokens after the directives: one branch of each conditional is read and macros are unfolded.

    A conditional without its end, an #else or #endif without its #if, and an #include without a name are
    errors. An unfolded token stands where its macro was called.
    """
    if "#" not in code:
        return _PLAIN_CPP(code, lang)
    kinds, error = lang.kinds, lang.error
    raw, at, size, fresh = [], int(code.startswith("\ufeff")), len(code), True
    macros: dict[str, tuple[list[str] | None, list[tuple[str, str, int]]]] = {}
    levels: list[list[bool]] = []  # (is this branch read, has one been read, has #else been seen)
    reading = True
    while at < size:
        if fresh and (d := _DIRECTIVE.match(code, at)) and "#" in d[0]:
            word, rest = _WORD.match(_COMMENT.sub(" ", _SPLICE.sub(" ", d[0]))).groups()
            if word in ("if", "ifdef", "ifndef"):
                on = reading and (_holds(rest, macros) if word == "if" else (rest.strip() in macros) == (word == "ifdef"))
                levels.append([on, on, False, reading])
            elif word in ("elif", "else"):
                if not levels or levels[-1][2]:
                    raw.append(("error", "", at))
                    break
                top = levels[-1]
                on = top[3] and not top[1] and (word == "else" or _holds(rest, macros))
                top[0], top[1], top[2] = on, top[1] or on, word == "else"
            elif word == "endif":
                if not levels:
                    raw.append(("error", "", at))
                    break
                reading = levels.pop()[3]
            elif reading and word == "include" and not _INCLUDE.match(rest):
                raw.append(("error", "", at))
                break
            elif reading and word == "define" and (m := _DEFINE.match(_COMMENT.sub(" ", _SPLICE.sub(" ", d[0])))):
                names = [x.strip() for x in m[3].split(",")] if m[2] is not None else None
                macros[m[1]] = (names if names != [""] else [], _cpp_tokens(m[4], at))
            elif reading and word == "undef":
                macros.pop(rest.strip(), None)
            if word in ("if", "ifdef", "ifndef", "elif", "else"):
                reading = levels[-1][0]
            at, fresh = d.end(), False
            continue
        m = _CPP_TOKEN.match(code, at)
        if m is None:
            if reading:
                raw.append(("error", "", at))
                break
            at += 1
            continue
        group = m.lastgroup
        if group == "line":
            fresh = True
        elif group != "skip":
            fresh = False
            if reading:
                raw.append((group, m[0], at))
        at = m.end()
    else:
        if levels:
            raw.append(("error", "", size))
    out = []
    for group, text, place in _unfolded(raw, macros):
        if group == "NAME":
            out.append((lang.words.get(text, kinds["NAME"]), place))
        elif group == "op":
            out.append((kinds.get(text, error), place))
        else:
            out.append((error if group == "error" else kinds["STRING" if group in ("STRING", "d") else group], place))
    return out


def _cpp_tokens(text: str, place: int) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _CPP_TOKEN.match(text, at)
        if m is None:  # # and ## of a macro's body
            at += 1
            continue
        if m.lastgroup not in ("skip", "line"):
            out.append((m.lastgroup, m[0], place))
        at = m.end()
    return out


def _unfolded(tokens: list[tuple[str, str, int]], macros: dict) -> list[tuple[str, str, int]]:
    """The tokens with all macros unfolded; a macro is not unfolded within itself."""
    if not macros:
        return tokens
    out: list[tuple[str, str, int]] = []
    stack = [(*t, frozenset()) for t in reversed(tokens)]
    while stack and len(out) < UNFOLDED:
        group, text, place, hidden = stack.pop()
        known = macros.get(text) if group == "NAME" and text not in hidden else None
        if known is None:
            out.append((group, text, place))
            continue
        names, body = known
        given: dict[str, list] = {}
        if names is not None:
            if not stack or stack[-1][1] != "(":
                out.append((group, text, place))
                continue
            stack.pop()
            depth, args = 1, [[]]
            while stack and depth:
                t = stack.pop()
                depth += (t[1] in ("(", "[", "{")) - (t[1] in (")", "]", "}")) if t[0] == "op" else 0
                if depth == 1 and t[1] == "," and t[0] == "op" and not (names and names[-1].endswith("...") and len(args) == len(names)):
                    args.append([])
                elif depth:
                    args[-1].append(t)
            given = dict(zip(((n.rstrip(".") or "__VA_ARGS__") if n.endswith("...") else n for n in names), args))
        inner = hidden | {text}
        for g, x, _ in reversed(body):
            if g == "NAME" and x in given:
                stack.extend(reversed(given[x]))
            else:
                stack.append((g, x, place, inner))
    return out


_PLAIN_CPP = _plain_lex(_CPP_TOKEN, True)
_MAKERS = {
    "cpp17": lambda: Language(CPP, _cpp_lex, {"override", "final"}),
    "java": lambda: Language(JAVA, _plain_lex(_JAVA_TOKEN, False), {"record", "sealed", "permits", "yield", "when"}),
    "python3": lambda: Language(PYTHON, _python_lex, {"match", "case", "type"}),
}
_MADE: dict[str, Language] = {}


def language(name: str) -> Language | None:
    """The language of a stated name, built once a process; None for other names."""
    if name not in _MADE and name in _MAKERS:
        _MADE[name] = _MAKERS[name]()
    return _MADE.get(name)
