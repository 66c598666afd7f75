"""Grammars of the supported languages, for gll.Grammar.

They follow the public language references, in the form a recogniser needs:
operator precedence and semantic rules are left out, so a text is rejected only
for its shape. P, B, K, I and T groups are parentheses, braces, brackets,
indented blocks and template strings.
"""

from __future__ import annotations

from functools import lru_cache

from siftgrain.llm.gll import Grammar


def cut_after(*ends):
    """Cuts a sequence after each of the tokens."""
    ends = frozenset(ends) | {"\n" + e for e in ends}

    def cut(tokens):
        pieces, start = [], 0
        for i, t in enumerate(tokens):
            if t in ends:
                pieces.append(tokens[start : i + 1])
                start = i + 1
        if start < len(tokens) or not pieces:
            pieces.append(tokens[start:])
        return pieces

    return cut


#: Words that go on with the statement before.
_GOES_ON = frozenset("else catch finally while instanceof in of as is extends implements permits throws from with where satisfies".split())


def cut_statements(tokens):
    """Cuts after a semicolon, and between a group and a word or mark that begins a statement; a guess, which the grammar checks."""
    pieces, start = [], 0
    for i, t in enumerate(tokens):
        if i + 1 == len(tokens):
            break
        after = tokens[i + 1]
        if isinstance(after, int):
            continue
        plain = after.lstrip("\n")
        word = plain[:1].isalpha() and plain not in _GOES_ON
        if isinstance(t, int) and (word and plain[0].islower() or plain in ("@", "#", "}") or after[0] == "\n" and word) or t in (";", "\n;") and plain not in _GOES_ON:
            pieces.append(tokens[start : i + 1])
            start = i + 1
    pieces.append(tokens[start:])
    return pieces


COMMA = cut_after(",")

PYTHON = """
File = Stmts
Stmts = Stmt*
Suite = Stmt+
Stmt = Simple (';' Simple)* ';'? NEWLINE | If | While | For | Try | With | Def | Class | Match | 'async' (Def | With | For) | ('@' Named NEWLINE)+ ('async'? Def | Class)
Block = ':' (NEWLINE I{Suite} | Simple (';' Simple)* ';'? NEWLINE)
If = 'if' Named Block ('elif' Named Block)* ('else' Block)?
While = 'while' Named Block ('else' Block)?
For = 'for' Targets 'in' ExprList Block ('else' Block)?
Try = 'try' Block (Except+ ('else' Block)? ('finally' Block)? | 'finally' Block)
Except = 'except' ('*'? Expr (',' Expr)* ('as' ID)?)? Block
With = 'with' WithItems Block
WithItems = WithItem (',' WithItem)*
WithItem = Expr ('as' Target)?
WithBody = WithItem (',' WithItem)* ','?
Def = 'def' ID K{TypeParams}? P{Params} ('->' Expr)? Block
Class = 'class' ID K{TypeParams}? P{Args}? Block
TypeParams = TypeParam (',' TypeParam)* ','?
TypeParam = ('*' | '**')? ID (':' Expr)? ('=' Expr)?
Match = 'match' ExprList ':' NEWLINE I{Cases}
Cases = Case+
Case = 'case' Patterns ('if' Named)? Block
Patterns = Pattern (',' Pattern)* ','?
Pattern = '*'? PatOr ('as' ID)?
PatOr = PatAtom ('|' PatAtom)*
PatAtom = ('+' | '-')? NUM (('+' | '-') NUM)? | STR+ | CONST | ID ('.' ID)* P{PatArgs}? | P{PatBody} | K{PatBody} | B{PatDict}
PatBody = Patterns?
PatArgs = (PatArg (',' PatArg)* ','?)?
PatArg = (ID '=')? Pattern
PatDict = (PatPair (',' PatPair)* ','?)?
PatPair = '**' ID | (('-')? NUM | STR+ | CONST | ID ('.' ID)*) ':' Pattern
Simple = 'pass' | 'break' | 'continue' | 'return' ExprList? | Raise | 'global' ID (',' ID)* | 'nonlocal' ID (',' ID)* | 'del' ExprList | 'assert' Expr (',' Expr)? | Import | 'type' ID K{TypeParams}? '=' Expr | Assign
Raise = 'raise' (Expr ('from' Expr)?)?
Import = 'import' ImportName (',' ImportName)* | 'from' ('.' | '...')* Dotted? 'import' ('*' | ImportAs (',' ImportAs)* | P{ImportBody})
ImportName = Dotted ('as' ID)?
ImportAs = ID ('as' ID)?
ImportBody = ImportAs (',' ImportAs)* ','?
Dotted = ID ('.' ID)*
Assign = ExprList (':' Expr ('=' ExprList)? | AUG ExprList | ('=' ExprList)*)
ExprList = Star (',' Star)* ','?
Star = '*' Or | Named | Yield
Named = ID ':=' Expr | Expr
Expr = 'lambda' LambdaParams? ':' Expr | Or ('if' Or 'else' Expr)?
Or = Not (('and' | 'or') Not)*
Not = 'not'* Compare
Compare = Arith ((CMP | 'in' | 'not' 'in' | 'is' 'not'?) 'not'? Arith)*
Arith = Unary (BOP Unary)*
Unary = (UOP | 'await')* Postfix
Postfix = Atom ('.' ID | P{Args} | K{Subscripts})*
Atom = ID | NUM | STR+ | CONST | '...' | P{ParenBody} | K{ListBody} | B{DictBody}
ParenBody = ElemsBody | Star CompFor | WithBody
ListBody = ElemsBody | Star CompFor
ElemsBody = ElemComma* Star?
ElemComma = Star ','
DictBody = Pairs | ElemsBody | Star CompFor | Expr ':' Expr CompFor | '**' Expr CompFor
Pairs = PairComma* Pair?
PairComma = Pair ','
Pair = Expr ':' Expr | '**' Or
Args = ArgComma* Arg? | Named CompFor
ArgComma = Arg ','
Arg = '*' Expr | '**' Expr | ID '=' Expr | Named
Params = ParamComma* Param?
ParamComma = Param ','
Param = '/' | '*' (ID (':' Star)?)? | '**' ID (':' Expr)? | ID (':' Expr)? ('=' Expr)?
LambdaParams = LambdaParam (',' LambdaParam)* ','?
LambdaParam = '/' | '*' ID? | '**' ID | ID ('=' Expr)?
CompFor = ('async'? 'for' Targets 'in' Or ('if' CompIf)*)+
CompIf = Or | 'lambda' LambdaParams? ':' Expr | ID ':=' Expr
Targets = Target (',' Target)* ','?
Target = '*'? Postfix
Yield = 'yield' ('from' Expr | ExprList)?
Subscripts = Subscript (',' Subscript)* ','?
Subscript = Named | '*' Or | Expr? ':' Expr? (':' Expr?)?
"""

PYTHON_2 = """
Simple = 'pass' | 'break' | 'continue' | 'return' ExprList? | Raise | 'global' ID (',' ID)* | 'del' ExprList | 'assert' Expr (',' Expr)? | Import | 'print' ('>>' Expr (',' Expr)* ','? | ExprList?) | 'exec' Expr ('in' Expr (',' Expr)?)? | Assign
Raise = 'raise' (Expr (',' Expr (',' Expr)?)?)?
Except = 'except' (Expr ((',' | 'as') Target)?)? Block
"""

JAVASCRIPT = """
Module = Item*
Item = Import | Export | Stmt
Import = 'import' (STR | ImportClause 'from' STR) (('with' | 'assert') B{Obj})? Semi
ImportClause = ID (',' ('*' 'as' ID | B{Specs}))? | '*' 'as' ID | B{Specs}
Specs = (Spec ',')* Spec?
Spec = (NAME | STR) ('as' (NAME | STR))?
Export = 'export' ('default' (Func | Class | Assign Semi) | Decl | B{Specs} ('from' STR (('with' | 'assert') B{Obj})?)? Semi | '*' ('as' (NAME | STR))? 'from' STR Semi)
Decl = VarDecl | Func | Class
Semi = ';' | %nl
Stmts = Stmt*
Stmt = B{Stmts} | ';' | VarDecl | Func | Class | 'if' P{Expr} Stmt ('else' Stmt)? | 'for' 'await'? P{ForHead} Stmt | 'while' P{Expr} Stmt | 'do' Stmt 'while' P{Expr} ';'? | Try | 'switch' P{Expr} B{Cases} | 'return' (%same Expr)? Semi | 'throw' Expr Semi | 'break' (%same ID)? Semi | 'continue' (%same ID)? Semi | 'debugger' Semi | ID ':' Stmt | Expr Semi
Try = 'try' B{Stmts} ('catch' P{CatchParam}? B{Stmts} ('finally' B{Stmts})? | 'finally' B{Stmts})
CatchParam = Binding
Cases = (('case' Expr | 'default') ':' Stmts)*
ForHead = (('var' | 'let' | 'const') Binding (',' Binding)* | Expr)? ';' Expr? ';' Expr? | (('var' | 'let' | 'const') Pattern | Postfix) ('in' | 'of') Expr
VarDecl = ('var' | 'let' | 'const') Binding (',' Binding)* Semi
Binding = Pattern ('=' Assign)?
Pattern = ID | B{ObjPattern} | K{ArrPattern}
ObjPattern = (ObjPatternItem ',')* ObjPatternItem?
ObjPatternItem = '...' Pattern | PropName (':' Pattern)? ('=' Assign)?
ArrPattern = (ArrPatternItem? ',')* ArrPatternItem?
ArrPatternItem = '...'? Pattern ('=' Assign)?
Func = 'async'? 'function' '*'? ID? P{Params} B{Stmts}
Params = (Param ',')* Param?
Param = Decorator* '...'? Pattern ('=' Assign)?
Decorator = '@' Postfix
Class = Decorator* 'class' ID? ('extends' Postfix)? B{Members}
Members = Member*
Member = ';' | 'static' B{Stmts} | Decorator* 'static'? (('async'? '*'? | 'get' | 'set') PropName P{Params} B{Stmts} | PropName ('=' Assign)? Semi)
PropName = NAME | STR | NUM | K{Assign} | PRIVATE
Expr = Assign (',' Assign)*
Assign = Arrow | 'yield' '*'? Assign? | Cond (ASSIGN Assign)?
Arrow = 'async'? (ID | P{Params}) '=>' (B{Stmts} | Assign)
Cond = Bin ('?' Assign ':' Assign)?
Bin = Unary (BinOp Unary)*
BinOp = BOP | '<' | '>' | '>' '>' | '>' '>' '>' | '>' '='
Unary = UOP* Postfix ('++' | '--')?
Postfix = 'new'* Primary Suffix*
Suffix = '.' (NAME | PRIVATE) | '?.' (NAME | PRIVATE | P{Args} | K{Expr}) | P{Args} | K{Expr} | T{Template}
Primary = ID | NUM | STR | REGEX | PRIVATE | T{Template} | K{Arr} | B{Obj} | P{Expr} | Func | Class | CONST | 'this' | 'super' | 'import' ('.' ID | P{Args}) | 'new' '.' ID
Template = B{Expr}*
Obj = ObjComma* ObjItem?
ObjComma = ObjItem ','
ObjItem = '...' Assign | NAME ('=' Assign)? | PropName ':' Assign | ('async'? '*'? | 'get' | 'set') PropName P{Params} B{Stmts}
Arr = ArrComma* ArrItem?
ArrComma = ArrItem? ','
ArrItem = '...'? Assign
Args = ArrItemComma* ArrItem?
ArrItemComma = ArrItem ','
"""

SCRIPT = """
Item = Stmt
Stmt = B{Stmts} | ';' | VarDecl | Func | Class | 'if' P{Expr} Stmt ('else' Stmt)? | 'for' P{ForHead} Stmt | 'while' P{Expr} Stmt | 'with' P{Expr} Stmt | 'do' Stmt 'while' P{Expr} ';'? | Try | 'switch' P{Expr} B{Cases} | 'return' (%same Expr)? Semi | 'throw' Expr Semi | 'break' (%same ID)? Semi | 'continue' (%same ID)? Semi | 'debugger' Semi | ID ':' Stmt | Expr Semi
"""

TYPESCRIPT = """
Import = 'import' 'type'? (STR | ImportClause 'from' STR) (('with' | 'assert') B{Obj})? Semi | 'import' 'type'? ID '=' ('require' P{Args} | Ref) Semi
Spec = 'type'? (NAME | STR) ('as' (NAME | STR))?
Export = 'export' ('default' (Func | Class | Interface | 'abstract' Class | Assign Semi) | Decl | 'type'? B{Specs} ('from' STR (('with' | 'assert') B{Obj})?)? Semi | 'type'? '*' ('as' (NAME | STR))? 'from' STR Semi | '=' Assign Semi | 'as' 'namespace' ID Semi | 'import' ID '=' ('require' P{Args} | Ref) Semi)
Decl = VarDecl | Func | Class | 'abstract' Class | Interface | TypeAlias | Enum | Namespace | 'declare' Decl | 'declare' 'global' B{Module}
Stmt = B{Stmts} | ';' | Decl | 'if' P{Expr} Stmt ('else' Stmt)? | 'for' 'await'? P{ForHead} Stmt | 'while' P{Expr} Stmt | 'do' Stmt 'while' P{Expr} ';'? | Try | 'switch' P{Expr} B{Cases} | 'return' (%same Expr)? Semi | 'throw' Expr Semi | 'break' (%same ID)? Semi | 'continue' (%same ID)? Semi | 'debugger' Semi | ID ':' Stmt | Expr Semi
Interface = 'interface' ID TypeParams? ('extends' TypeList)? B{TypeMembers}
TypeAlias = 'type' ID TypeParams? '=' Type Semi
Enum = 'const'? 'enum' ID B{EnumBody}
EnumBody = (EnumItem ',')* EnumItem?
EnumItem = PropName ('=' Assign)?
Namespace = ('namespace' | 'module') (ID ('.' ID)* | STR) (B{Module} | Semi)
Binding = Pattern '!'? TypeAnn? ('=' Assign)?
Func = 'async'? 'function' '*'? ID? TypeParams? P{Params} TypeAnn? (B{Stmts} | Semi)
Param = Decorator* Modifier* '...'? (Pattern | 'this') '?'? TypeAnn? ('=' Assign)?
Modifier = 'public' | 'private' | 'protected' | 'static' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor'
Class = Decorator* 'class' ID? TypeParams? ('extends' Postfix TypeArgs?)? ('implements' TypeList)? B{Members}
Member = ';' | 'static' B{Stmts} | Decorator* Modifier* (('async'? '*'? | 'get' | 'set') PropName '?'? TypeParams? P{Params} TypeAnn? (B{Stmts} | Semi) | PropName ('?' | '!')? TypeAnn? ('=' Assign)? Semi | K{IndexSig} TypeAnn Semi)
IndexSig = ID ':' Type
TypeAnn = ':' (TypePred | Type)
TypePred = 'asserts'? (ID | 'this') 'is' Type | 'asserts' (ID | 'this')
TypeList = Ref TypeArgs? (',' Ref TypeArgs?)*
Ref = NAME ('.' NAME)*
TypeArgs = '<' Type (',' Type)* '>'
TypeParams = '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam = ('in' | 'out' | 'const')* ID ('extends' Type)? ('=' Type)?
Type = FuncType | Union ('extends' (Union | FuncType) '?' Type ':' Type)? | TypePred
FuncType = 'abstract'? 'new'? TypeParams? P{Params} '=>' (TypePred | Type)
Union = ('|' | '&')? TypeUnary (('|' | '&') (TypeUnary | FuncType))*
TypeUnary = ('keyof' | 'readonly' | 'unique')* TypePrim (%same K{IndexType})* | 'infer' ID ('extends' Union)?
IndexType = Type?
TypePrim = Ref TypeArgs? | 'typeof' (Ref | 'import' P{Type} ('.' NAME)*) TypeArgs? | STR | NUM | '-' NUM | T{TypeTemplate} | B{TypeMembers} | K{TupleBody} | P{Type} | 'void' | 'this' | CONST | 'import' P{Type} ('.' NAME)* TypeArgs?
TypeTemplate = B{Type}*
TupleBody = (TupleItem ',')* TupleItem?
TupleItem = '...'? (NAME '?'? ':')? Type '?'?
TypeMembers = (TypeMember (';' | ',' | %nl))* TypeMember?
TypeMember = ('readonly' | '-' 'readonly' | '+' 'readonly' | 'get' | 'set')? (PropName | K{MappedKey}) ('?' | '-' '?' | '+' '?')? (TypeParams? P{Params})? TypeAnn? | 'new'? TypeParams? P{Params} TypeAnn?
MappedKey = ID 'in' Type ('as' Type)? | ID ':' Type | Assign
Arrow = 'async'? (ID | TypeParams? P{Params} TypeAnn?) '=>' (B{Stmts} | Assign)
ObjItem = '...' Assign | NAME ('=' Assign)? | PropName ':' Assign | ('async'? '*'? | 'get' | 'set') PropName TypeParams? P{Params} TypeAnn? B{Stmts}
Bin = Unary (BinOp Unary | ('as' | 'satisfies') (Type | 'const'))*
Unary = (UOP | '<' Type '>')* Postfix ('++' | '--')?
Suffix = '.' (NAME | PRIVATE) | '?.' (NAME | PRIVATE | TypeArgs? P{Args} | K{Expr}) | P{Args} | K{Expr} | T{Template} | %same '!' | TypeArgs (P{Args} | T{Template})?
"""

JAVA = """
File = Package? (Import | ';')* TypeDecl* | Import* Annotation* 'open'? 'module' Qual B{Any}
Any = ANY*
Package = Annotation* 'package' Qual ';'
Import = 'import' 'static'? Qual ('.' '*')? ';'
TypeDecl = Modifiers Type1 | ';'
Type1 = Class | Interface | Enum | Record | AnnotationDecl
Modifiers = (Annotation | MOD | 'sealed' | 'non' '-' 'sealed' | 'default')*
Annotation = '@' Qual P{AnnotationArgs}?
AnnotationArgs = ((ID '=')? ElementValue (',' (ID '=')? ElementValue)* ','?)?
ElementValue = Annotation | B{ElementValues} | Cond
ElementValues = (ElementValue ',')* ElementValue?
Qual = ID ('.' ID)*
Class = 'class' ID TypeParams? ('extends' Type)? ('implements' TypeList)? ('permits' TypeList)? B{Members}
Interface = 'interface' ID TypeParams? ('extends' TypeList)? ('permits' TypeList)? B{Members}
AnnotationDecl = '@' 'interface' ID B{Members}
Enum = 'enum' ID ('implements' TypeList)? B{EnumBody}
EnumBody = (EnumConst (',' EnumConst)* ','?)? (';' Members)?
EnumConst = Annotation* ID P{Args}? B{Members}?
Record = 'record' ID TypeParams? P{Params} ('implements' TypeList)? B{Members}
TypeParams = '<' TypeParam (',' TypeParam)* '>'
TypeParam = Annotation* ID ('extends' Type ('&' Type)*)?
TypeList = Type (',' Type)*
Type = Annotation* (PRIM | ID TypeArgs? ('.' Annotation* ID TypeArgs?)*) Dims?
TypeArgs = '<' (TypeArg (',' TypeArg)*)? '>'
TypeArg = Annotation* '?' (('extends' | 'super') Type)? | Type
Dims = (Annotation* K{Empty})+
Empty =
Members = Member*
Member = ';' | 'static'? B{Stmts} | Modifiers Type1 | Modifiers TypeParams? (Type | 'void')? ID P{Params} Dims? ('throws' TypeList)? (B{Stmts} | ('default' ElementValue)? ';') | Modifiers Type Declarators ';' | Modifiers ID B{Stmts}
Declarators = Declarator (',' Declarator)*
Declarator = ID Dims? ('=' Init)?
Init = Expr | B{ArrayInit}
ArrayInit = InitComma* Init?
InitComma = Init ','
Params = (Param (',' Param)*)?
Param = Modifiers Type (Annotation* '...')? (ID ('.' 'this')? | 'this') Dims?
Stmts = Stmt*
Stmt = B{Stmts} | ';' | LocalVar ';' | Modifiers Type1 | 'if' P{Expr} Stmt ('else' Stmt)? | 'while' P{Expr} Stmt | 'do' Stmt 'while' P{Expr} ';' | 'for' P{ForHead} Stmt | Try | 'switch' P{Expr} B{Switch} | 'synchronized' P{Expr} B{Stmts} | 'return' Expr? ';' | 'throw' Expr ';' | 'break' ID? ';' | 'continue' ID? ';' | 'yield' Expr ';' | 'assert' Expr (':' Expr)? ';' | ID ':' Stmt | Cond (ASSIGN Expr)? ';'
Try = 'try' (P{Resources} B{Stmts} Catch* Finally? | B{Stmts} (Catch+ Finally? | Finally))
Resources = Resource (';' Resource)* ';'?
Resource = Modifiers Type ID '=' Expr | Postfix
Catch = 'catch' P{CatchParam} B{Stmts}
CatchParam = Modifiers Type ('|' Type)* ID
Finally = 'finally' B{Stmts}
LocalVar = Modifiers Type Declarators
ForHead = (LocalVar | Expr (',' Expr)*)? ';' Expr? ';' (Expr (',' Expr)*)? | Modifiers Type ID ':' Expr
Switch = (CaseLabel (':' Stmts | '->' (Expr ';' | B{Stmts} | 'throw' Expr ';')))*
CaseLabel = 'case' CaseItem (',' CaseItem)* ('when' Expr)? | 'default'
CaseItem = Cond | 'default' | CasePattern
CasePattern = Modifiers Type (ID | P{CasePatterns} ID?)
CasePatterns = (CasePattern (',' CasePattern)*)?
Expr = Lambda | Cond (ASSIGN Expr)?
Lambda = (ID | P{LambdaParams}) '->' (B{Stmts} | Expr)
LambdaParams = Params | (ID (',' ID)*)?
Cond = Bin ('?' Expr ':' Expr)?
Bin = Unary (BinOp (Unary | Lambda) | 'instanceof' (Modifiers Type ID? | CasePattern))*
BinOp = BOP | '<' | '>' | '>' '>' | '>' '>' '>' | '>' '='
Unary = UOP* Postfix | UOP* P{CastType} (Unary | Lambda)
CastType = Type ('&' Type)*
Postfix = Primary Suffix* ('++' | '--')*
Suffix = '.' (TypeArgs? ID | TypeArgs? 'super' | 'class' | 'this' | 'new' Creator) | P{Args} | K{Expr} | '::' TypeArgs? (ID | 'new')
Primary = ID | NUM | STR | CONST | P{Expr} | 'this' | 'super' | 'new' Creator | (PRIM | 'void') Dims? '.' 'class' | Type '::' TypeArgs? (ID | 'new') | Type '.' 'class' | 'switch' P{Expr} B{Switch}
Creator = Annotation* TypeArgs? (PRIM | ID TypeArgs? ('.' Annotation* ID TypeArgs?)*) (P{Args} B{Members}? | (Annotation* K{Expr})+ Dims? | Dims B{ArrayInit})
Args = ArgComma* Expr?
ArgComma = Expr ','
"""

GO = """
File = 'package' ID ';' (ImportDecl ';')* (TopDecl ';')*
ImportDecl = 'import' (ImportSpec | P{ImportSpecs})
ImportSpec = (ID | '.')? STR
ImportSpecs = (ImportSpec ';')* ImportSpec?
TopDecl = Func | Decl
Func = 'func' P{Params}? ID K{TypeParams}? P{Params} Result? B{Stmts}?
TypeParams = TypeParam (',' TypeParam)* ','?
TypeParam = ID (',' ID)* Union
Union = '~'? Type ('|' '~'? Type)*
Decl = 'var' (VarSpec | P{VarSpecs}) | 'const' (VarSpec | P{VarSpecs}) | 'type' (TypeSpec | P{TypeSpecs})
VarSpec = ID (',' ID)* Type? ('=' Exprs)?
VarSpecs = (VarSpec ';')* VarSpec?
TypeSpec = ID K{TypeParams}? '='? Type
TypeSpecs = (TypeSpec ';')* TypeSpec?
Type = Qual K{Types}? | '*' Type | K{Length} Type | 'map' K{Type} Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' P{Params} Result? | 'struct' B{Fields} | 'interface' B{Methods} | P{Type}
Qual = ID ('.' ID)?
Types = Type (',' Type)* ','?
Length = Expr? | '...'
Params = (Param (',' Param)* ','?)?
Param = ID? '...'? Type
Result = P{Params} | Type
Fields = (Field ';')* Field?
Field = ID (',' ID)* Type STR? | '*'? Qual K{Types}? STR?
Methods = (Method ';')* Method?
Method = ID P{Params} Result? | Union
Exprs = Expr (',' Expr)*
Stmts = StmtSemi* Stmt?
StmtSemi = Stmt? ';'
Stmt = Decl | Simple | 'return' Exprs? | If | 'for' ForHead? B{Stmts} | 'switch' (Simple? ';')? SwitchTag? B{Cases} | 'select' B{Cases} | 'go' Expr | 'defer' Expr | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | B{Stmts} | ID ':' Stmt?
If = 'if' (Simple? ';')? Expr B{Stmts} ('else' (If | B{Stmts}))?
ForHead = Expr | Simple? ';' Expr? ';' Simple? | (Exprs ('=' | ':='))? 'range' Expr
SwitchTag = Expr | ID ':=' Expr
Cases = (('case' CaseItems | 'default') ':' Stmts)*
CaseItems = CaseItem (',' CaseItem)*
CaseItem = Simple | Type
Simple = Exprs (ASSIGN Exprs | ':=' Exprs | '++' | '--' | '<-' Expr)?
Expr = Unary (BOP Unary)*
Unary = UOP* Postfix
Postfix = Primary ('.' (ID | P{TypeOrWord}) | K{Index} | P{Args})*
TypeOrWord = Type | 'type'
Index = Expr | Types | Expr? ':' Expr? (':' Expr?)?
Primary = ID | NUM | STR | P{Expr} | Literal B{Elems} | 'func' P{Params} Result? B{Stmts} | Convert P{Args} | P{Type}
Literal = Qual K{Types}? | K{Length} Type | 'map' K{Type} Type | 'struct' B{Fields}
Convert = K{Length} Type | 'map' K{Type} Type | 'chan' '<-'? Type | 'interface' B{Methods} | 'struct' B{Fields} | '*' Type
Elems = ElemComma* Elem?
ElemComma = Elem ','
Elem = (Value ':')? Value
Value = Expr | B{Elems}
Args = ArgComma* Arg?
ArgComma = Arg ','
Arg = (Expr | Type) '...'?
"""

RUST = """
File = InnerAttr* Item*
Items = Item*
Any = ANY*
Attr = '#' K{Any}
InnerAttr = '#' '!' K{Any}
Item = Attr* Vis? (Fn | Struct | Enum | Union | Trait | Impl | Mod | Use | Const | Static | TypeAlias | 'extern' 'crate' NAME ('as' ID)? ';' | 'unsafe'? 'extern' STR? B{Externs} | MacroItem)
Vis = 'pub' P{Any}?
MacroItem = Path '!' ID? (P{Any} ';' | K{Any} ';' | B{Any})
Externs = InnerAttr* (Attr* Vis? 'safe'? (Fn | Static | TypeAlias | MacroItem))*
Fn = ('const' | 'async' | 'unsafe' | 'safe' | 'extern' STR?)* 'fn' ID Generics? P{FnParams} ('->' Type)? Where? (B{Stmts} | ';')
FnParams = (FnParam ',')* FnParam?
FnParam = Attr* ('&' LIFETIME? 'mut'? 'self' | 'mut'? 'self' (':' Type)? | Pat ':' Type | Type | '...')
Generics = '<' (GenParam (',' GenParam)* ','?)? '>'
GenParam = Attr* (LIFETIME (':' Bounds?)? | ID (':' Bounds?)? ('=' Type)? | 'const' ID ':' Type ('=' Expr)?)
Where = 'where' (WherePred ',')* WherePred?
WherePred = ('for' Generics)? (LIFETIME | Type) ':' Bounds?
Bounds = Bound ('+' Bound)* '+'?
Bound = LIFETIME | '~'? 'const'? '?'? ('for' Generics)? TypePath | P{Bound} | 'use' '<' (LIFETIME | ID) (',' (LIFETIME | ID))* '>'
Struct = 'struct' ID Generics? Where? (';' | B{Fields} | P{TupleFields} Where? ';')
Union = 'union' ID Generics? Where? B{Fields}
Fields = (Field ',')* Field?
Field = Attr* Vis? ID ':' Type
TupleFields = (Attr* Vis? Type ',')* (Attr* Vis? Type)?
Enum = 'enum' ID Generics? Where? B{Variants}
Variants = (Variant ',')* Variant?
Variant = Attr* Vis? ID (B{Fields} | P{TupleFields})? ('=' Expr)?
Trait = 'unsafe'? 'auto'? 'trait' ID Generics? (':' Bounds?)? Where? B{ImplItems}
Impl = 'unsafe'? 'impl' Generics? 'const'? '!'? Type ('for' Type)? Where? B{ImplItems}
ImplItems = InnerAttr* (Attr* Vis? 'default'? (Fn | Const | TypeAlias | MacroItem))*
Mod = 'unsafe'? 'mod' ID (';' | B{File})
Use = 'use' UseTree ';'
UseTree = '::'? UseSeg ('::' UseSeg)* ('as' (ID | '_'))?
UseSeg = NAME | '*' | B{UseTrees}
UseTrees = (UseTree ',')* UseTree?
Const = 'const' (ID | '_') ':' Type ('=' Expr)? ';'
Static = 'static' 'mut'? ID ':' Type ('=' Expr)? ';'
TypeAlias = 'type' ID Generics? (':' Bounds)? Where? ('=' Type)? Where? ';'
Type = P{TypeTuple} | '!' | '&' LIFETIME? 'mut'? Type | '*' ('const' | 'mut') Type | K{ArrayType} | ('for' Generics)? ('unsafe' | 'extern' STR?)* 'fn' P{FnTypeParams} ('->' Type)? | ('impl' | 'dyn') Bounds | TypePath ('!' (P{Any} | K{Any} | B{Any}))? ('+' Bound)* | '_'
TypeTuple = (Type ',')* Type? | Bounds
ArrayType = Type (';' Expr)?
FnTypeParams = (FnTypeParam ',')* FnTypeParam?
FnTypeParam = Attr* (ID ':' | '_' ':')? Type | '...'
TypePath = '::'? TypeSeg ('::' TypeSeg)* | '<' Type ('as' TypePath)? '>' ('::' TypeSeg)+
TypeSeg = PATHWORD ('::'? GenArgs | '::'? P{TypeTuple} ('->' Type)?)?
GenArgs = '<' (GenArg (',' GenArg)* ','?)? '>'
GenArg = LIFETIME | Type | ID GenArgs? '=' Type | ID GenArgs? ':' Bounds | '-'? LIT | B{Stmts}
Stmts = InnerAttr* Stmt* Last?
StmtsHead = InnerAttr* Stmt*
StmtsMiddle = Stmt*
StmtsEnd = Stmt* Last?
Last = Attr* Expr
Stmt = ';' | Item | Attr* 'let' Pat (':' Type)? ('=' Expr ('else' B{Stmts})?)? ';' | Attr* Expr ';' | Attr* BlockExpr
BlockExpr = (LIFETIME ':')? ('unsafe'? B{Stmts} | 'const' B{Stmts} | 'async' 'move'? B{Stmts} | 'loop' B{Stmts} | 'while' Cond B{Stmts} | 'for' Pat 'in' Expr B{Stmts}) | If | 'match' Expr B{Arms} | Path '!' B{Any}
If = 'if' Cond B{Stmts} ('else' (If | B{Stmts}))?
Cond = CondPart ('&' '&' CondPart)*
CondPart = 'let' Pat '=' Expr | Expr
Arms = InnerAttr* Arm* LastArm?
Arm = Attr* Pat ('if' Cond)? '=>' (Expr ',' | BlockExpr ','?)
LastArm = Attr* Pat ('if' Cond)? '=>' Expr
Expr = Range (ASSIGN Expr)? | Jump
Jump = 'return' Expr? | 'break' LIFETIME? Expr? | 'continue' LIFETIME? | Closure
Closure = 'static'? 'async'? 'move'? '|' ClosureParams '|' ('->' Type B{Stmts} | Expr)
ClosureParams = (ClosureParam ',')* ClosureParam?
ClosureParam = Attr* PatNo (':' Type)?
Range = Bin | Bin? RANGE Bin?
Bin = Unary (BinOp (Unary | Jump) | 'as' Type)*
BinOp = BOP | '<' | '>' | '>' '>' | '>' '=' | '&' '&' | '|' '|' | '<' '='
Unary = (UOP | '&' 'mut'? | '&' 'raw' ('const' | 'mut'))* Postfix
Postfix = Primary ('?' | '.' (ID ('::' GenArgs)? | NUM | 'await') | P{Args} | K{Expr})*
Primary = LIT | Path B{StructInit}? | Path '!' (P{Any} | K{Any} | B{Any}) | P{Tuple} | K{Array} | BlockExpr | '_'
Path = '::'? PathSeg ('::' (PathSeg | GenArgs))* | '<' Type ('as' TypePath)? '>' ('::' (PathSeg | GenArgs))+
PathSeg = PATHWORD
StructInit = (StructField ',')* (StructField | '..' Expr | '..')?
StructField = Attr* (ID | NUM) (':' Expr)?
Tuple = ArgComma* Expr?
Array = ArgComma* Expr? | Expr ';' Expr
Args = ArgComma* Expr?
ArgComma = Attr* Expr ','
Pat = '|'? PatNo ('|' PatNo)*
PatNo = '_' | RANGE | 'ref'? 'mut'? ID ('@' PatNo)? | PatLit (RANGE PatLit?)? | RANGE PatLit | '&' '&'? 'mut'? PatNo | P{Pats} | K{Pats} | Path (P{Pats} | B{FieldPats})? | 'box' PatNo | Path '!' (P{Any} | K{Any}) | 'const' B{Stmts}
PatLit = '-'? LIT | Path
Pats = (Attr* Pat ',')* (Attr* Pat)?
FieldPats = (FieldPat ',')* (FieldPat | Attr* '..')?
FieldPat = Attr* ((ID | NUM) ':' Pat | 'box'? 'ref'? 'mut'? ID)
"""

JSON = """
File = Value
Value = STR | NUM | CONST | K{Elems} | B{Pairs}
Elems = (Value (',' Value)*)?
ElemComma = Value ','
Pairs = (Pair (',' Pair)*)?
PairComma = Pair ','
Pair = STR ':' Value
"""

TOML = """
File = (Line? NEWLINE)* Line?
Line = K{Header} | K{HeaderArray} | Pair
Header = Key
HeaderArray = K{Header}
Key = KeyPart ('.' KeyPart)*
KeyPart = BARE | NUM | BOOL | DATE | KEYSTR
Pair = Key '=' Value
Value = KEYSTR | STR | NUM | BOOL | DATE | K{Array} | B{Inline}
Array = ElemComma* Value?
ElemComma = Value ','
Inline = (Pair (',' Pair)* ','?)?
"""

YAML = """
File = Docs
Docs = DIRECTIVE* Doc? (DOCEND* DOCSTART Doc?)* DOCEND*
Doc = Node
Node = Map | Seq | Props? SCALAR NEWLINE PlainRest? | Scalars | Flow NEWLINE | Props? BLOCK NEWLINE | Props NEWLINE (Map | Seq | Scalars) | ALIAS NEWLINE | I{Node}
Scalars = Props? (PLAIN NEWLINE)+ PlainRest?
PlainRest = I{PlainLines}
PlainLines = (PLAIN NEWLINE)* PlainRest?
Props = (ANCHOR | TAG)+
Flow = Props? (K{FlowSeq} | B{FlowMap})
FlowSeq = FlowComma* FlowItem?
FlowComma = FlowItem ','
FlowItem = FlowValue (':' FlowValue?)? | ':' FlowValue? | '?' FlowValue (':' FlowValue?)?
FlowValue = Props? FlowScalar | Flow | ALIAS | Props
FlowScalar = PLAIN+ | QUOTED
FlowMap = FlowComma* FlowItem?
Map = Entry+
Entry = Key ':' Rest | '?' Inside (':' Inside)?
Key = Props? SCALAR | Flow | ALIAS
Rest = Props? SCALAR NEWLINE PlainRest? | Props? BLOCK NEWLINE | Flow NEWLINE | ALIAS NEWLINE | Props? NEWLINE (I{Node} | Seq)?
Inside = I{Node} | NEWLINE I{Node}? | NEWLINE Seq
Seq = SeqItem+
SeqItem = '-' (I{Node} | Props? NEWLINE (I{Node})? | Props NEWLINE Seq)
"""

MARKDOWN = """
File = ANY*
"""

_PY_WORDS = "if elif else while for try except finally with def class return raise global nonlocal del assert import from pass break continue lambda and or not in is as yield async await None True False".split()
_JS_WORDS = "if else for while do try catch finally switch case default return throw break continue debugger var const function class extends new delete typeof void in instanceof this super null true false import export with enum".split()
_TS_WORDS = [w for w in _JS_WORDS if w != "with"]
_JAVA_WORDS = "if else for while do try catch finally switch case default return throw break continue class interface enum extends implements new instanceof this super null true false import package public private protected static final abstract native synchronized transient volatile strictfp void int long short byte char boolean float double throws assert const goto".split()
_GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
_RUST_WORDS = "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn".split()


@lru_cache(None)
def grammar(language: str) -> Grammar:
    """The compiled grammar of a language; one per process, since its memo tables serve all files."""
    if language == "python":
        return Grammar(
            PYTHON, {"python3": "File", "python2": "File"}, _PY_WORDS,
            {"CONST": {"None", "True", "False"}, "BOP": {"+", "-", "*", "/", "//", "%", "@", "&", "|", "^", "<<", ">>", "**"}, "UOP": {"+", "-", "~"},
             "CMP": {"<", ">", "<=", ">=", "==", "!=", "<>"}, "AUG": {"+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", "<<=", ">>=", "**="}},
            {"File": ("Stmts", "Stmts", cut_python), "Stmts": ("Stmts", "Stmts", cut_python), "Suite": ("Stmts", "Stmts", cut_python), "ListBody": ("ElemComma", "Star", COMMA), "ParenBody": ("ElemComma", "Star", COMMA), "DictBody": ("PairComma", "Pair", COMMA), "Args": ("ArgComma", "Arg", COMMA)},
            {"python2": PYTHON_2},
        )
    if language in ("javascript", "typescript"):
        js = language == "javascript"
        classes = {"CONST": {"null", "true", "false"} if js else {"null", "true", "false", "undefined"}, "UOP": {"+", "-", "!", "~", "++", "--", "typeof", "void", "delete", "await"},
                   "ASSIGN": {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", "&=", "|=", "^=", "&&=", "||=", "??=", ">>=", ">>>="},
                   "BOP": {"+", "-", "*", "/", "%", "**", "<<", "&", "|", "^", "&&", "||", "??", "==", "!=", "===", "!==", "<=", "in", "instanceof"}}
        lists = {"Module": ("Module", "Module", cut_statements), "Stmts": ("Stmts", "Stmts", cut_statements), "Members": ("Members", "Members", cut_statements), "Arr": ("ArrComma", "ArrItem", COMMA), "Obj": ("ObjComma", "ObjItem", COMMA), "Args": ("ArrItemComma", "ArrItem", COMMA)}
        if js:
            return Grammar(JAVASCRIPT, {"module": "Module", "script": "Module"}, _JS_WORDS, classes, lists, {"script": SCRIPT})
        return Grammar(JAVASCRIPT, {"typescript": "Module"}, _TS_WORDS, classes, lists, {"typescript": TYPESCRIPT})
    if language == "java":
        return Grammar(
            JAVA, {"java": "File"}, _JAVA_WORDS,
            {"CONST": {"null", "true", "false"}, "PRIM": {"int", "long", "short", "byte", "char", "boolean", "float", "double"}, "UOP": {"+", "-", "!", "~", "++", "--"},
             "MOD": {"public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp"},
             "ASSIGN": {"=", "+=", "-=", "*=", "/=", "%=", "<<=", "&=", "|=", "^=", ">>=", ">>>="}, "BOP": {"+", "-", "*", "/", "%", "<<", "&", "|", "^", "&&", "||", "==", "!=", "<="}},
            {"Members": ("Members", "Members", cut_statements), "Stmts": ("Stmts", "Stmts", cut_statements), "Args": ("ArgComma", "Expr", COMMA), "ArrayInit": ("InitComma", "Init", COMMA)},
        )
    if language == "go":
        return Grammar(
            GO, {"go": "File"}, _GO_WORDS,
            {"UOP": {"+", "-", "!", "^", "*", "&", "<-"}, "ASSIGN": {"=", "+=", "-=", "*=", "/=", "%=", "<<=", ">>=", "&=", "|=", "^=", "&^="},
             "BOP": {"+", "-", "*", "/", "%", "<<", ">>", "&", "|", "^", "&^", "&&", "||", "==", "!=", "<", "<=", ">", ">="}},
            {"Stmts": ("StmtSemi", "Stmts", cut_after(";")), "Elems": ("ElemComma", "Elem", COMMA), "Args": ("ArgComma", "Arg", COMMA)},
        )
    if language == "rust":
        return Grammar(
            RUST, {"rust": "File"}, _RUST_WORDS,
            {"UOP": {"-", "!", "*"}, "ASSIGN": {"=", "+=", "-=", "*=", "/=", "%=", "<<=", ">>=", "&=", "|=", "^="}, "LIT": {"NUM", "STR", "CHAR", "true", "false"}, "RANGE": {"..", "..=", "..."},
             "PATHWORD": {"ID", "self", "Self", "super", "crate", *"union auto default safe raw box macro_rules".split()}, "BOP": {"+", "-", "*", "/", "%", "<<", "^", "&", "|", "==", "!=", "<=", ">="}},
            {"File": ("Items", "Items", cut_statements, "File"), "Stmts": ("StmtsMiddle", "StmtsEnd", cut_statements, "StmtsHead"), "Array": ("ArgComma", "Expr", COMMA), "Args": ("ArgComma", "Expr", COMMA)},
        )
    if language == "json":
        return Grammar(JSON, {"json": "File"}, (), {"CONST": {"true", "false", "null"}}, {"Elems": ("ElemComma", "Value", cut_pairs), "Pairs": ("PairComma", "Pair", cut_pairs)})
    if language == "toml":
        return Grammar(TOML, {"toml": "File"}, (), {}, {"File": ("File", "File", cut_after("NEWLINE")), "Array": ("ElemComma", "Value", COMMA)})
    if language == "yaml":
        return Grammar(YAML, {"yaml": "File"}, (), {"SCALAR": {"PLAIN", "QUOTED"}}, {"Map": ("Map", "Map", cut_entries), "FlowSeq": ("FlowComma", "FlowItem", COMMA), "FlowMap": ("FlowComma", "FlowItem", COMMA)})
    if language == "markdown":
        return Grammar(MARKDOWN, {"markdown": "File"})
    raise KeyError(language)


def cut_python(tokens):
    """Cuts after a line's end or an indented block, unless the next line goes on with the statement."""
    pieces, start = [], 0
    for i in range(len(tokens) - 1):
        t, after = tokens[i], tokens[i + 1]
        if (t == "NEWLINE" or isinstance(t, int)) and isinstance(after, str) and after not in ("elif", "else", "except", "finally", "NEWLINE"):
            if t == "NEWLINE" or i and tokens[i - 1] == "NEWLINE":
                pieces.append(tokens[start : i + 1])
                start = i + 1
    pieces.append(tokens[start:])
    return pieces


def cut_entries(tokens):
    """Cuts a YAML mapping between its entries: before a key that follows a line's end or a block."""
    pieces, start = [], 0
    for i in range(1, len(tokens) - 1):
        if tokens[i] in ("PLAIN", "QUOTED") and tokens[i + 1] == ":" and (tokens[i - 1] == "NEWLINE" or isinstance(tokens[i - 1], int)):
            pieces.append(tokens[start:i])
            start = i
    pieces.append(tokens[start:])
    return pieces


def cut_pairs(tokens):
    """As COMMA, but a comma at the very end is left to the grammar."""
    pieces = COMMA(tokens)
    return [tokens] if tokens and tokens[-1] == "," else pieces
