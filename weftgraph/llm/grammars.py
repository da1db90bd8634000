"""Grammars of seven languages for the chart parser.

A rule is a regular expression over token classes and bracketed groups, ``p:X`` for (X), ``s:X`` for [X], ``b:X`` for {X} and ``i:X``
for an indented block; all recursion goes through groups. ``$x`` puts in rule x; ``( A )~ B`` is one or more A with B between. Quoted words are tokens. Operator precedence is left out: it has no part in what is valid.
The rules take a little more than the languages where a check needs meaning rather than form.
"""

from __future__ import annotations


def _alt(words: str) -> str:
    return "( " + " | ".join(f"'{w}'" for w in words.split()) + " )"


def _list(x: str) -> str:
    return f"( ( {x} )~ ',' ( ',' )? )"


PYTHON = {
    "name": "( NAME | 'match' | 'case' | 'type' )",
    "lpar": "( ( ( '*' | '**' )? $name | '*' | '/' ) ( '=' $b0 )? )",
    "b0": "( ( $operand0 )~ ( $bin ) )",
    "bin": _alt("+ - * ** / // % @ << >> & | ^ < > == >= <= != in and or is") + " | 'not' 'in' | 'is' 'not'",
    "atom": "( $name | NUM | STR ( STR )* | 'None' | 'True' | 'False' | '...' | p:Tuple | s:List | b:Dict )",
    "post": "( '.' $name | p:Args | s:Sub )",
    "operand0": "( ( " + _alt("not - + ~ await") + " )* $atom ( $post )* )",
    "operand": "( ( 'lambda' ( ( $lpar )~ ',' ( ',' )? )? ':' )? $operand0 )",
    "disj": "( ( $operand )~ ( $bin ) )",
    "expr": "( $disj ( 'if' $disj 'else' $disj )* )",
    "star": "( ( '*' )? $expr )",
    "named": "( $expr ( ':=' $expr )? )",
    "exprs": _list("$star"),
    "target": "( ( '*' )? $atom ( $post )* )",
    "targets": _list("$target"),
    "comp": "( ( ( 'async' )? 'for' $targets 'in' $disj ( 'if' $expr )* )+ )",
    "yield": "( 'yield' ( 'from' $expr | $exprs )? )",
    "Tuple": "( $yield | ( ( '*' )? $named ( ',' ( '*' )? $named )* ( ',' )? )? | $named $comp )",
    "List": "( ( ( '*' )? $named ( ',' ( '*' )? $named )* ( ',' )? )? | $named $comp )",
    "ditem": "( $expr ':' $expr | '**' $disj )",
    "Dict": "( ( ( $ditem )~ ',' ( ',' )? )? | $expr ':' $expr $comp | ( '*' )? $named ( ',' ( '*' )? $named )* ( ',' )? | $named $comp )",
    "arg": "( $name '=' $expr | '*' $expr | '**' $expr | $named | $named $comp )",
    "Args": f"( {_list('$arg')} )?",
    "slice": "( ( $expr )? ':' ( $expr )? ( ':' ( $expr )? )? | ( '*' )? $named )",
    "Sub": _list("$slice"),
    "par": "( ( '*' | '**' )? $name ( ':' $star )? ( '=' $expr )? | '*' | '/' )",
    "Params": f"( {_list('$par')} )?",
    "dotted": "( ( $name )~ '.' )",
    "alias": "( $name ( 'as' $name )? )",
    "Aliases": _list("$alias"),
    "import": "( 'import' $dotted ( 'as' $name )? ( ',' $dotted ( 'as' $name )? )* | 'from' ( ( '.' | '...' )* $dotted | ( '.' | '...' )+ ) 'import' ( '*' | ( $alias )~ ',' | p:Aliases ) )",
    "rhs": "( $exprs | $yield )",
    "assign": "( $exprs ( '=' $rhs )* | $target ':' $expr ( '=' $rhs )? | $target " + _alt("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=") + " $rhs )",
    "simple": "( $assign | $yield | $import | 'return' ( $exprs )? | 'raise' ( $expr ( 'from' $expr )? )? | 'del' $targets | 'assert' $expr ( ',' $expr )? | ( 'global' | 'nonlocal' ) ( $name )~ ',' | 'pass' | 'break' | 'continue' | 'type' NAME ( s:Params )? '=' $expr )",
    "line": "( ( $simple )~ ';' ( ';' )? NEWLINE )",
    "block": "( NEWLINE i:File1 )",
    "inline": "( ( ( 'if' | 'elif' | 'while' ) $named | 'else' | 'try' | 'finally' | 'except' ( '*' )? ( $exprs ( 'as' $name )? )? | ( 'async' )? 'for' $targets 'in' $exprs | ( 'async' )? 'with' ( $exprs ( 'as' $targets )? | p:Withs ) | ( 'async' )? 'def' $name ( s:Params )? p:Params ( '->' $exprs )? | 'class' $name ( s:Params )? ( p:Args )? ) ':' $line )",
    "head": "( 'if' $named ':' $block ( 'elif' $named ':' $block )* ( 'else' ':' $block )? | 'while' $named ':' $block ( 'else' ':' $block )? | ( 'async' )? 'for' $targets 'in' $exprs ':' $block ( 'else' ':' $block )?"
    " | 'try' ':' $block ( ( 'except' ( '*' )? ( ( $expr )~ ',' ( 'as' $name )? )? ':' $block )+ ( 'else' ':' $block )? ( 'finally' ':' $block )? | 'finally' ':' $block )"
    " | ( 'async' )? 'with' ( $expr ( 'as' $target )? ( ',' $expr ( 'as' $target )? )* | p:Withs ) ':' $block | 'match' $exprs ':' NEWLINE i:Cases )",
    "Withs": _list("( $expr ( 'as' $target )? )"),
    "Cases": "( 'case' $casepat ( 'if' $named )? ':' ( $block | $line ) )+",
    "casepat": _list("( ( '*' )? $expr ( 'as' $name )? )"),
    "def": "( ( '@' $named NEWLINE )* ( ( 'async' )? 'def' $name ( s:Params )? p:Params ( '->' $exprs )? ':' $block | 'class' $name ( s:Params )? ( p:Args )? ':' $block ) )",
    "stmt": "( $line | $head | $def | ( '@' $named NEWLINE )* $inline ( ( 'elif' $named | 'else' | 'finally' | 'except' ( '*' )? ( $exprs ( 'as' $name )? )? ) ':' $block )* )",
    "File1": "( $stmt )+",
    "File": "( $stmt )*",
}

_JSBIN = "+ - * ** / % << >> >>> & | ^ && || ?? < > <= >= == != === !== in instanceof = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= =>"
JS = {
    "name": "( NAME | " + _alt("async of get set static from as let await yield")[2:-2] + " )",
    "prop": "( NAME | " + " | ".join(f"'{w}'" for w in sorted(set("break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield async await let of get set static from as".split()))) + " )",
    "key": "( $prop | STR | NUM | s:Index )",
    "fn": "( ( 'async' )? 'function' ( '*' )? ( $name )? $sig b:Block )",
    "sig": "( p:Params )",
    "class": "( 'class' ( $name )? ( 'extends' $super )? b:Class )",
    "super": "( ( $name | p:Paren ) ( '.' $prop | p:Args )* )",
    "prim": "( $name | NUM | STR | 'this' | 'super' | 'null' | 'true' | 'false' | p:Paren | s:Array | b:Object | $fn | $class | 'import' ( '.' NAME )? )",
    "post": "( '.' $prop | '?.' ( $prop | p:Args | s:Index ) | p:Args | s:Index | STR | '++' | '--' | '=>' b:Block )",
    "pre": "( " + _alt("! ~ + - ++ -- typeof void delete await new yield") + " | 'yield' '*' | 'async' )",
    "unary0": "( ( $pre )* $prim ( $post )* )",
    "operand": "$unary0",
    "bin": _alt(_JSBIN),
    "b0": "( ( $operand )~ ( $bin ) )",
    "expr": "( $b0 ( ( '?' $b0 )+ ( ':' $b0 )+ )* | 'yield' )",
    "Paren": "( ( ( '...' )? $expr )~ ',' ( ',' )? )?",
    "Args": "( ( ( '...' )? $expr )~ ',' ( ',' )? )?",
    "Array": "( ( ',' )* ( ( ( '...' )? $expr )~ ( ( ',' )+ ) ( ',' )* )? )",
    "Index": "( ( $expr )~ ',' )",
    "bind": "( $name | b:Pattern | s:PatArray )",
    "Pattern": "( ( ( $key ':' $bind | $name ) ( '=' $expr )? ( ',' ( $key ':' $bind | $name ) ( '=' $expr )? )* ( ',' ( '...' $bind )? )? | '...' $bind )? )",
    "PatArray": "( ( ',' )* ( ( '...' )? $bind ( '=' $expr )? ( ( ',' )+ ( '...' )? $bind ( '=' $expr )? )* ( ',' )* )? )",
    "par": "( ( '...' )? $bind ( '=' $expr )? )",
    "Params": f"( {_list('$par')} )?",
    "mods": "( ( 'async' | 'get' | 'set' | '*' )* )",
    "member": "( $key ':' $expr | $name ( '=' $expr )? | '...' $expr | $mods $key $sig b:Block )",
    "Object": f"( {_list('$member')} )?",
    "Class": "( ( 'static' )? $mods $key $sig b:Block | ( 'static' )? $key ( '=' $expr )? ( ';' | NL ) | 'static' b:Block | ';' | NL )* ( ( 'static' )? $key ( '=' $expr )? )?",
    "decl": "( $bind ( '=' $expr )? )",
    "vars": "( ( 'var' | 'let' | 'const' ) ( $decl )~ ',' )",
    "spec": "( ( $prop | STR ) ( 'as' ( $prop | STR ) )? )",
    "Specs": f"( {_list('$spec')} )?",
    "imp": "( 'import' ( STR | ( $name ( ',' ( b:Specs | '*' 'as' $name ) )? | b:Specs | '*' 'as' $name ) 'from' STR ) ( 'with' b:Object )? )",
    "exp": "( 'export' ( '*' ( 'as' $prop )? 'from' STR | b:Specs ( 'from' STR )? ) )",
    "exprs": "( ( $expr )~ ',' )",
    "simple": "( ( 'return' | 'throw' | 'export' 'default' )? $exprs | ( 'export' )? $vars | 'return' | 'break' ( NAME )? | 'continue' ( NAME )? | 'debugger' | $imp | $exp )",
    "For": "( ( ( $vars | $exprs )? ';' ( $exprs )? ';' ( $exprs )? ) | ( ( ( 'var' | 'let' | 'const' )? $bind | $unary0 ) ( 'of' | 'in' ) $exprs ) )",
    "Cond": "( $exprs )",
    "Cases": "( NL | ( 'case' $exprs | 'default' ) ':' $body )*",
    "solid": "( b:Block | ( 'export' ( 'default' )? )? ( $fn | $class ) | 'try' b:Block ( 'catch' ( p:Params )? b:Block ( 'finally' b:Block )? | 'finally' b:Block ) | 'switch' p:Cond b:Cases | 'while' p:Cond )",
    "lead": "( 'if' p:Cond | 'else' | 'for' ( 'await' )? p:For | 'while' p:Cond | 'with' p:Cond | 'do' | NAME ':' )",
    "term": "( ';' | NL )",
    "body": "( ( $lead )* ( $solid | ( $simple )? $term ) )* ( ( $lead )* $simple )?",
    "Block": "$body",
    "File": "$body",
}

TS = dict(JS)
_TSWORDS = "abstract any declare enum implements infer interface is keyof namespace module private protected public readonly type satisfies unique override"
TS |= {
    "name": JS["name"][:-2] + " | " + _alt(_TSWORDS.replace("enum", "").replace("  ", " "))[2:-2] + " )",
    "prop": JS["prop"][:-2] + " | " + _alt(_TSWORDS)[2:-2] + " )",
    "qname": "( $name ( '.' $prop )* )",
    "t0": "( ( 'keyof' | 'typeof' | 'readonly' | 'unique' | 'infer' )* ( $qname | STR | NUM | '-' NUM | 'null' | 'void' | 'this' | 'true' | 'false' | b:TypeBody | s:TypeList | p:FnPars '=>' $qname | p:FnPars ) ( s:TypeIdx )* )",
    "t3": "( $t0 ( '<' $t0 ( ( ',' | '|' | '&' | '<' | 'extends' | '=>' ) $t0 | '>' | s:TypeIdx )* '>' ( s:TypeIdx )* )? )",
    "type": "( ( '|' | '&' )? $t3 ( ( '|' | '&' | '=>' | 'is' | 'extends' | '?' | ':' ) $t3 )* )",
    "TypeIdx": "( $type )?",
    "TypeList": "( ( ( '...' )? ( $name ( '?' )? ':' )? $type ( '?' )? ( ',' ( '...' )? ( $name ( '?' )? ':' )? $type ( '?' )? )* ( ',' )? )? )",
    "FnPars": f"( {_list('$par')} | $type )?",
    "gen": "( '<' $name ( 'extends' $t3 )? ( '=' $t3 )? ( ',' $name ( 'extends' $t3 )? ( '=' $t3 )? )* '>' )",
    "ann": "( ':' $type )",
    "tmember": "( ( 'readonly' | 'get' | 'set' )* ( $key | s:KeySig ) ( '?' )? ( $ann | ( $gen )? p:Params ( $ann )? )? | ( 'new' )? ( $gen )? p:Params ( $ann )? )",
    "KeySig": "( $name ':' $type | $name 'in' $type )",
    "TypeBody": "( ( $tmember ( ( ';' | ',' | NL )+ $tmember )* ( ';' | ',' | NL )* )? )",
    "sig": "( ( $gen )? p:Params ( $ann )? )",
    "bin": JS["bin"],
    "post": JS["post"][:-2] + " | '!' | ( 'as' | 'satisfies' ) ( 'const' | $type ) | '<' ( $type )~ ',' '>' p:Args )",
    "prim": JS["prim"][:-2] + " | ( $gen )? p:Params ( $ann )? )",
    "par": "( ( '@' $name ( p:Args )? )* ( 'public' | 'private' | 'protected' | 'readonly' | 'override' )* ( '...' )? ( $bind | 'this' ) ( '?' )? ( $ann )? ( '=' $expr )? )",
    "decl": "( $bind ( '!' )? ( $ann )? ( '=' $expr )? )",
    "class": "( ( '@' ( $name )~ '.' ( p:Args )? ( NL )? )* ( 'abstract' )? 'class' ( $name )? ( $gen )? ( 'extends' $super ( '<' ( $type )~ ',' '>' )? )? ( 'implements' ( $type )~ ',' )? b:Class )",
    "cmods": "( ( " + _alt("static abstract private protected public readonly override declare async get set")[2:-2] + " | '*' )* )",
    "Class": "( ( '@' $name ( p:Args )? ( NL )? )* ( $cmods ( $key | s:KeySig ) ( '?' | '!' )? ( $sig ( b:Block )? | ( $ann )? ( '=' $expr )? ( ';' | NL ) ) ) | 'static' b:Block | ';' | NL )* ( $cmods $key ( '?' | '!' )? ( $ann )? ( '=' $expr )? )?",
    "spec": "( ( 'type' )? ( $prop | STR ) ( 'as' ( $prop | STR ) )? )",
    "imp": "( 'import' ( 'type' )? ( STR | ( $name ( ',' ( b:Specs | '*' 'as' $name ) )? | b:Specs | '*' 'as' $name ) 'from' STR | $name '=' $expr ) )",
    "alias": "( 'type' $name ( $gen )? '=' $type )",
    "exp": "( 'export' ( ( 'type' )? '*' ( 'as' $prop )? 'from' STR | ( 'type' )? b:Specs ( 'from' STR )? | $alias | 'as' 'namespace' $name ) )",
    "Enum": f"( {_list('( ( NAME | STR ) ( ' + chr(39) + '=' + chr(39) + ' $expr )? )')} )?",
    "solid": JS["solid"][:-2] + " | ( 'export' ( 'default' )? )? ( 'declare' )? ( 'interface' $name ( $gen )? ( 'extends' ( $type )~ ',' )? b:TypeBody | ( 'const' )? 'enum' $name b:Enum | ( 'namespace' | 'module' ) ( $qname | STR ) b:Block | $class ) )",
    "simple": JS["simple"][:-2] + " | ( 'declare' )? $alias | ( 'export' )? 'declare' ( $vars | 'function' $name $sig ) | ( 'export' )? ( 'async' )? 'function' $name $sig )",
}

GO = {
    "qname": "( NAME ( '.' NAME )? )",
    "t0": "( ( '*' | s:ArrLen | 'chan' | '<-' | 'chan' '<-' | 'map' s:Type )* ( $qname ( s:Types )? | 'struct' b:Fields | 'interface' b:Iface | p:Type | 'func' p:Params ( p:Results | ( '*' | s:ArrLen )* $qname )? ) )",
    "type": "$t0",
    "Type": "$type",
    "Types": _list("$type"),
    "ArrLen": "( $expr | '...' )?",
    "Results": f"( {_list('( ( NAME )? $type )')} )?",
    "Params": f"( {_list('( ( NAME )? ( ' + chr(39) + '...' + chr(39) + ' )? $type )')} )?",
    "sig": "( p:Params ( $type | p:Results )? )",
    "Fields": "( ( NAME ( ',' NAME )* $type | ( '*' )? $qname ) ( STR )? ';' )* ( ( NAME ( ',' NAME )* $type | ( '*' )? $qname ) ( STR )? )?",
    "Iface": "( ( NAME $sig | ( '~' )? $type ( '|' ( '~' )? $type )* ) ';' )* ( NAME $sig | ( '~' )? $type ( '|' ( '~' )? $type )* )?",
    "lit": "( b:Lit )",
    "Lit": f"( {_list('( ( ( $expr | b:Lit ) ' + chr(39) + ':' + chr(39) + ' )? ( $expr | b:Lit ) )')} )?",
    "prim": "( NAME | NUM | STR | p:Expr | 'func' $sig b:Block | ( s:ArrLen )+ ( '*' )? $type0 ( b:Lit )? | 'map' s:Type $type ( b:Lit )? | 'struct' b:Fields ( b:Lit )? | 'interface' b:Iface | 'chan' $type )",
    "type0": "( $qname | 'struct' b:Fields | 'map' s:Type $type | 'interface' b:Iface | 'func' $sig )",
    "Expr": "( $expr | $type )",
    "post": "( '.' ( NAME | p:Assert ) | p:Args | s:Index | b:Lit )",
    "Assert": "( $type | 'type' )",
    "Args": f"( {_list('( ( $expr | $type ) ( ' + chr(39) + '...' + chr(39) + ' )? )')} )?",
    "Index": "( ( $expr )? ':' ( $expr )? ( ':' ( $expr )? )? | ( $expr )~ ',' | ( $type )~ ',' )",
    "operand": "( ( " + _alt("+ - ! ^ * & <- ~") + " )* $prim ( $post )* )",
    "expr": "( $operand ( " + _alt("+ - * / % & | ^ &^ << >> && || == != < <= > >=") + " $operand )* )",
    "exprs": "( ( $expr )~ ',' )",
    "assign": "( $exprs ( ( " + _alt("= := += -= *= /= %= &= |= ^= <<= >>= &^=") + " $exprs ) | '++' | '--' | '<-' $expr )? )",
    "spec": "( NAME ( ',' NAME )* ( $type )? ( '=' $exprs )? )",
    "Specs": "( $spec ';' )* ( $spec )?",
    "tspec": "( NAME ( s:Params )? ( '=' )? $type )",
    "TSpecs": "( $tspec ';' )* ( $tspec )?",
    "decl": "( ( 'var' | 'const' ) ( $spec | p:Specs ) | 'type' ( $tspec | p:TSpecs ) )",
    "head": "( ( $assign )? ';' )? ( $assign )?",
    "range": "( ( $exprs ( '=' | ':=' ) )? 'range' $expr )",
    "ifs": "( ( 'if' ( ( $assign )? ';' )? $expr b:Block )~ 'else' ( 'else' b:Block )? )",
    "for": "( 'for' ( $range | ( $assign )? ';' ( $expr )? ';' ( $assign )? | ( $expr )? ) b:Block )",
    "switch": "( 'switch' $head b:Cases | 'select' b:Cases )",
    "Cases": "( ( 'case' ( $assign | $exprs | ( $type )~ ',' ) | 'default' ) ':' $body )*",
    "stmt": "( $assign | $decl | 'return' ( $exprs )? | 'break' ( NAME )? | 'continue' ( NAME )? | 'goto' NAME | 'fallthrough' | ( 'go' | 'defer' ) $expr | b:Block | $ifs | $for | $switch )",
    "body": "( ( NAME ':' )? ( $stmt )? ';' )* ( ( NAME ':' )? $stmt )?",
    "Block": "$body",
    "isp": "( ( NAME | '.' )? STR )",
    "Imports": "( $isp ';' )* ( $isp )?",
    "func": "( 'func' ( p:Params )? NAME ( s:Params )? $sig ( b:Block )? )",
    "File": "( ( 'package' NAME ';' ( 'import' ( $isp | p:Imports ) ';' )* ( ( $func | $decl ) ';' )* )? )",
}

JAVA = {
    "ann": "( '@' NAME ( '.' NAME )* ( p:AnnArgs )? )",
    "AnnArgs": f"( {_list('( ( NAME ' + chr(39) + '=' + chr(39) + ' )? ( $expr | b:ArrInit | $ann ) )')} )?",
    "word": "( NAME | 'record' | 'sealed' | 'permits' | 'yield' | 'var' )",
    "basic": _alt("boolean byte char double float int long short void"),
    "t0": "( ( $ann )* ( ( $word )~ '.' | $basic ) ( s:None )* )",
    "ta": "( $t0 | '?' ( ( 'extends' | 'super' ) $t0 )? )",
    "type": "( $t0 ( '<' '>' | '<' $ta ( ( ',' | '&' | '<' ) $ta | '>' | '.' $word | s:None )* '>' ( '.' $word | s:None )* )? )",
    "None": "( )",
    "gen": "( '<' $word ( 'extends' ( $type )~ '&' )? ( ',' $word ( 'extends' ( $type )~ '&' )? )* '>' )",
    "prim": "( $word | NUM | STR | 'this' | 'super' | 'null' | 'true' | 'false' | p:Paren | $basic ( s:None )* '.' 'class' | 'new' $type ( p:Args ( b:Class )? | ( s:Index )+ ( s:None )* | b:ArrInit ) | 'switch' p:Cond b:Switch )",
    "Paren": "( $expr | ( $type )~ '&' | ( ( ( 'final' )? ( $type )? $word ) ( ',' ( 'final' )? ( $type )? $word )* )? )",
    "post": "( '.' ( $word | 'this' | 'super' | 'class' | 'new' $type p:Args ( b:Class )? | '<' ( $type )~ ',' '>' $word ) | p:Args | s:Index | s:None | '::' ( $word | 'new' ) | '++' | '--' | 'instanceof' ( 'final' )? $type ( $word )? | '->' b:Block )",
    "operand": "( ( " + _alt("+ - ! ~ ++ --") + " | p:Cast )* $prim ( $post )* )",
    "Cast": "( ( $type )~ '&' )",
    "bin": _alt("+ - * / % & | ^ && || == != < > <= >= << = += -= *= /= %= &= |= ^= <<= >>= >>>= ->") + " | '>' '>' | '>' '>' '>'",
    "b0": "( ( $operand )~ ( $bin ) )",
    "expr": "( $b0 ( ( '?' $b0 )+ ( ':' $b0 )+ )* )",
    "Args": f"( {_list('$expr')} )?",
    "Index": "( $expr )",
    "ArrInit": f"( {_list('( $expr | b:ArrInit )')} )?",
    "decl": "( $word ( s:None )* ( '=' ( $expr | b:ArrInit ) )? )",
    "vars": "( ( 'final' | $ann )* $type ( $decl )~ ',' )",
    "Cond": "( $expr )",
    "For": "( ( $vars | ( $expr )~ ',' )? ';' ( $expr )? ';' ( ( $expr )~ ',' )? | ( 'final' | $ann )* $type $word ':' $expr )",
    "Res": "( ( $vars | $expr ) ( ';' ( $vars | $expr ) )* ( ';' )? )",
    "Catch": "( ( 'final' )? ( $type )~ '|' $word )",
    "simple": "( $expr | $vars | 'return' ( $expr )? | 'throw' $expr | 'break' ( NAME )? | 'continue' ( NAME )? | 'yield' $expr | 'assert' $expr ( ':' $expr )? )",
    "solid": "( b:Block | $typedecl | 'try' ( p:Res )? b:Block ( 'catch' p:Catch b:Block )* ( 'finally' b:Block )? | 'switch' p:Cond b:Switch | 'synchronized' p:Cond b:Block )",
    "lead": "( 'if' p:Cond | 'else' | 'for' p:For | 'while' p:Cond | 'do' | NAME ':' )",
    "body": "( ( $lead )* ( $solid | ( $simple )? ';' ) )*",
    "Block": "$body",
    "Switch": "( ( 'case' ( $expr )~ ',' | 'default' ) ( ':' $body | '->' ( $expr ';' | b:Block | 'throw' $expr ';' ) ) )*",
    "mods": "( ( $ann | " + _alt("public private protected static final abstract native synchronized transient volatile strictfp default sealed")[2:-2] + " )* )",
    "par": "( ( 'final' | $ann )* $type ( '...' )? ( $word | 'this' ) ( s:None )* )",
    "Params": f"( {_list('$par')} )?",
    "throws": "( ( 'throws' ( $type )~ ',' )? )",
    "typedecl": "( $mods ( 'class' $word ( $gen )? ( 'extends' $type )? ( 'implements' ( $type )~ ',' )? ( 'permits' ( $type )~ ',' )? b:Class | 'interface' $word ( $gen )? ( 'extends' ( $type )~ ',' )? ( 'permits' ( $type )~ ',' )? b:Class | 'enum' $word ( 'implements' ( $type )~ ',' )? b:Enum | 'record' NAME ( $gen )? p:Params ( 'implements' ( $type )~ ',' )? b:Class | '@' 'interface' NAME b:Class ) )",
    "member": "( $typedecl | $mods ( ( $gen )? $type $word p:Params ( s:None )* $throws ( b:Block | ( 'default' $expr )? ';' ) | ( $gen )? $word p:Params $throws b:Block | $type ( $decl )~ ',' ';' ) | ( 'static' )? b:Block | NAME b:Block | ';' )",
    "Class": "( $member )*",
    "Enum": "( ( ( $ann )* NAME ( p:Args )? ( b:Class )? ( ',' ( $ann )* NAME ( p:Args )? ( b:Class )? )* ( ',' )? )? ( ';' ( $member )* )? )",
    "File": "( ( $ann )* 'package' NAME ( '.' NAME )* ';' )? ( 'import' ( 'static' )? NAME ( '.' $word )* ( '.' '*' )? ';' | ';' )* ( $typedecl | ';' )*",
}

C = {
    "spec": "( " + _alt("const volatile static extern inline register auto typedef restrict") + " )",
    "base": "( ( " + _alt("void char short int long float double signed unsigned _Bool") + " )+ | ( 'struct' | 'union' ) ( NAME )? b:Fields | ( 'struct' | 'union' | 'enum' ) NAME | 'enum' ( NAME )? b:Enum | NAME )",
    "type": "( ( $spec )* $base ( $spec )* )",
    "ptr": "( ( '*' | 'const' | 'volatile' | 'restrict' )* )",
    "dtor": "( $ptr ( NAME | p:Dtor ) ( s:Dim | p:Params )* ( ':' $expr )? )",
    "Dtor": "( $ptr ( NAME )? ( s:Dim | p:Params )* )",
    "adtor": "( $ptr ( p:Dtor )? ( s:Dim | p:Params )* )",
    "Dim": "( $expr )?",
    "Params": f"( {_list('( $type ( $dtor | $adtor ) | ' + chr(39) + '...' + chr(39) + ' )')} )?",
    "Fields": "( $type ( ( $dtor )~ ',' )? ';' | ';' )*",
    "Enum": f"( {_list('( NAME ( ' + chr(39) + '=' + chr(39) + ' $expr )? )')} )?",
    "init": "( $expr | b:Init )",
    "Init": f"( {_list('( ( ( s:Index | ' + chr(39) + '.' + chr(39) + ' NAME )+ ' + chr(39) + '=' + chr(39) + ' )? $init )')} )?",
    "prim": "( NAME | NUM | STR ( STR )* | p:Expr | 'sizeof' p:TypeOr )",
    "Expr": "( $exprs | $type $adtor | b:Block )",
    "TypeOr": "( $type $adtor | $expr )",
    "post": "( '.' NAME | '->' NAME | p:Args | s:Index | '++' | '--' | b:Init )",
    "operand": "( ( " + _alt("+ - ! ~ * & ++ -- sizeof") + " | p:Cast )* $prim ( $post )* )",
    "Cast": "( $type $adtor )",
    "bin": _alt("+ - * / % & | ^ && || == != < > <= >= << >> = += -= *= /= %= &= |= ^= <<= >>="),
    "b0": "( ( $operand )~ ( $bin ) )",
    "expr": "( $b0 ( ( '?' $b0 )+ ( ':' $b0 )+ )* )",
    "exprs": "( ( $expr )~ ',' )",
    "Args": f"( {_list('( $expr | $type $adtor )')} )?",
    "Index": "( $exprs )",
    "decls": "( $type ( $dtor ( '=' $init )? ( ',' $dtor ( '=' $init )? )* )? )",
    "Cond": "( $exprs )",
    "For": "( ( $decls | $exprs )? ';' ( $exprs )? ';' ( $exprs )? )",
    "simple": "( $exprs | $decls | 'return' ( $exprs )? | 'break' | 'continue' | 'goto' NAME )",
    "lead": "( 'if' p:Cond | 'else' | 'for' p:For | 'while' p:Cond | 'do' | 'switch' p:Cond | NAME ':' | 'case' $expr ':' | 'default' ':' )",
    "Block": "( ( $lead )* ( b:Block | ( $simple )? ';' ) )* ( $lead )*",
    "File": "( $type $ptr NAME p:Params ( $decls ';' )* b:Block | $decls ';' | 'extern' STR ( b:File | $decls ';' ) | ';' )*",
}

RUST = {
    "attr": "( '#' ( '!' )? s:Any )",
    "Any": "( )",
    "word": "( NAME | 'union' )",
    "seg": "( $word | 'self' | 'Self' | 'super' | 'crate' )",
    "path0": "( ( '::' )? ( $seg )~ '::' )",
    "ta0": "( $t0 | LIFE | NUM | b:Block | $word '=' $t0 )",
    "t0": "( ( '&' | '&&' | 'mut' | LIFE | '*' 'const' | '*' 'mut' | 'dyn' | 'impl' )* ( $path0 | p:TypeTuple | s:ArrType | '!' | ( 'unsafe' )? ( 'extern' ( STR )? )? 'fn' p:FnTypes ( '->' $path0 )? ) ( p:TypeTuple ( '->' $path0 )? )? )",
    "t3": "( $t0 ( '<' ( $ta0 ( ( ',' | '<' | '+' ) $ta0 | '>' | '::' $seg )* ( ',' )? )? '>' ( '::' $seg )* )? )",
    "type": "( $t3 ( '+' ( ( '?' )? $t3 | LIFE ) )* )",
    "TypeTuple": f"( {_list('$type')} )?",
    "FnTypes": f"( {_list('( ( $word ' + chr(39) + ':' + chr(39) + ' )? $type )')} )?",
    "ArrType": "( $type ( ';' $expr )? )",
    "bound": "( ( ( '?' )? $t3 | LIFE | p:TypeTuple ) ( '+' ( ( '?' )? $t3 | LIFE ) )* )",
    "gpar": "( LIFE ( ':' LIFE )? | 'const' $word ':' $t3 | $word ( ':' ( $bound )? )? ( '=' $t3 )? )",
    "gen": "( '<' ( ( $gpar )~ ',' ( ',' )? )? '>' )",
    "where": "( ( 'where' ( ( $type | LIFE ) ':' $bound ( ',' ( $type | LIFE ) ':' $bound )* ( ',' )? )? )? )",
    "vis": "( ( 'pub' ( p:Any )? )? )",
    "self": "( ( '&' ( LIFE )? )? ( 'mut' )? 'self' ( ':' $type )? )",
    "Params": f"( {_list('( ( $attr )* ( $self | $pat ' + chr(39) + ':' + chr(39) + ' $type ) )')} )?",
    "pat1": "( ( '&' | '&&' | 'ref' | 'mut' )* ( $path0 ( p:Pats | b:FieldPats )? ( '@' $pat0 )? | ( '-' )? NUM | STR | 'true' | 'false' | p:Pats | s:Pats | '..' ) ( ( '..' | '..=' ) ( ( '-' )? NUM | STR | $path0 )? )? )",
    "pat0": "( ( '-' )? NUM | STR | p:Pats | $path0 )",
    "pat": "( ( '|' )? ( $pat1 )~ '|' )",
    "Pats": f"( {_list('$pat')} )?",
    "FieldPats": f"( {_list('( ( NAME | NUM ) ' + chr(39) + ':' + chr(39) + ' $pat | ( ' + chr(39) + 'ref' + chr(39) + ' )? ( ' + chr(39) + 'mut' + chr(39) + ' )? NAME | ' + chr(39) + '..' + chr(39) + ' )')} )?",
    "turbo": "( '::' '<' ( $ta0 ( ( ',' | '<' | '+' ) $ta0 | '>' | '::' $seg )* ( ',' )? )? '>' )",
    "epath": "( ( '::' )? $seg ( '::' $seg | $turbo )* | '<' $t3 ( 'as' $t3 )? '>' ( '::' $seg )+ )",
    "macro": "( $path0 '!' ( NAME )? ( p:Any | s:Any | b:Any ) )",
    "blocky": "( ( LIFE ':' )? ( 'unsafe' b:Block | 'async' ( 'move' )? b:Block | b:Block | $ifs | 'loop' b:Block | ( 'match' | 'for' $pat 'in' ) $cond ( b:Arms | b:Block ) ) )",
    "ifs": "( ( ( 'if' | 'while' ) $cond b:Block )~ 'else' ( 'else' b:Block )? )",
    "cond": "( ( ( 'let' $pat '=' )? $exprx )~ '&&' )",
    "primx": "( $epath | NUM | STR | 'true' | 'false' | p:Tuple | s:Array | $macro | ( 'unsafe' )? b:Block | 'match' $path0 b:Arms | $path0 b:Struct )",
    "exprx": "( ( $pre $primx ( $post )* | '..' )~ ( $bin ) ( '..' )? )",
    "clo": "( ( 'move' )? ( '||' | '|' ( $pat1 ( ':' $t3 )? ( ',' $pat1 ( ':' $t3 )? )* ( ',' )? )? '|' ) ( '->' $t3 )? )",
    "prim": "( $epath | NUM | STR | 'true' | 'false' | p:Tuple | s:Array | $macro | $blocky | ( 'return' | 'break' ( LIFE )? ) | 'continue' ( LIFE )? | $path0 b:Struct )",
    "post": "( '.' ( NAME ( $turbo )? | NUM | 'await' ) | p:Args | s:Index | '?' | 'as' $t3 )",
    "pre": "( ( " + _alt("- ! * & &&")[2:-2] + " | '&' 'mut' | '&&' 'mut' | 'return' | 'break' ( LIFE )? | $clo | '..' | '..=' )* )",
    "operand": "( $pre $prim ( $post )* | '..' )",
    "bin": _alt("+ - * / % & | ^ && || == != < > <= >= << .. ..= = += -= *= /= %= &= |= ^= <<= >>=") + " | '>' '>'",
    "expr0": "( $operand ( ( $bin ) $operand )* ( '..' )? )",
    "expr": "$expr0",
    "Tuple": f"( {_list('$expr')} )?",
    "Args": f"( {_list('$expr')} )?",
    "Array": f"( {_list('$expr')} | $expr ';' $expr )?",
    "Index": "( $expr )",
    "Struct": f"( {_list('( ( $attr )* ( NAME | NUM ) ( ' + chr(39) + ':' + chr(39) + ' $expr )? | ' + chr(39) + '..' + chr(39) + ' ( $expr )? )')} )?",
    "arm": "( ( $attr )* $pat ( 'if' $cond )? '=>' )",
    "Arms": "( ( $arm $expr )~ ',' ( ',' )? | ( $arm $blocky ( ',' )? | $arm $expr ',' )* ( $arm $expr )? )",
    "let": "( 'let' $pat ( ':' $type )? ( '=' $expr ( 'else' b:Block )? )? ';' )",
    "Block": "( ( $attr )* ( $let | $item | ';' | $expr ';' | $blocky | $path0 '!' ( NAME )? b:Any ) )* ( $expr )?",
    "fn": "( ( 'const' | 'async' | 'unsafe' | 'extern' ( STR )? )* 'fn' $word ( $gen )? p:Params ( '->' $type )? $where ( b:Block | ';' ) )",
    "Fields": f"( {_list('( ( $attr )* $vis $word ' + chr(39) + ':' + chr(39) + ' $type )')} )?",
    "TFields": f"( {_list('( ( $attr )* $vis $type )')} )?",
    "Variants": f"( {_list('( ( $attr )* NAME ( b:Fields | p:TFields )? ( ' + chr(39) + '=' + chr(39) + ' $expr )? )')} )?",
    "use": "( ( '::' )? ( $seg '::' )* ( $seg ( 'as' $word )? | '*' | b:Uses ) )",
    "Uses": f"( {_list('$use')} )?",
    "item": "( ( $attr )* $vis ( $fn | 'use' $use ';' | 'mod' $word ( b:Items | ';' ) | 'struct' $word ( $gen )? ( $where b:Fields | p:TFields $where ';' | ';' ) | 'union' $word b:Fields | 'enum' $word ( $gen )? $where b:Variants | ( 'unsafe' )? 'impl' ( $gen )? ( '!' )? $type ( 'for' $type )? $where b:Items"
    " | ( 'unsafe' )? 'trait' $word ( $gen )? ( ':' $bound )? $where b:Items | 'type' $word ( $gen )? ( ':' $bound )? ( '=' $type )? $where ';' | ( 'const' | 'static' ) ( 'mut' )? $word ':' $type ( '=' $expr )? ';' | 'extern' 'crate' $word ';' | ( 'unsafe' )? 'extern' ( STR )? b:Items ) )",
    "Items": "( $item | $attr | $path0 '!' ( NAME )? ( b:Any | ( p:Any | s:Any ) ';' ) )*",
    "File": "$Items",
}
RUST["File"] = RUST["Items"]

GRAMMARS = {"python": PYTHON, "js": JS, "ts": TS, "go": GO, "java": JAVA, "c": C, "rust": RUST}
