"""Parsing-expression grammars of the five languages, for validity only: binary operators are flat.

One rule a line; lines indented by four blanks continue it.
"""

from __future__ import annotations

from functools import cache

from codeweft.llm.peg import Grammar

PYTHON = """
File <- Stmt* EOF
Stmt <- Simple / Compound / SoftCompound
Block <- NEWLINE INDENT Stmt+ DEDENT / Simple
Simple <- Small (';' Small)* ';'? NEWLINE
Small <- 'pass' / 'break' / 'continue' / 'return' StarExprs? / 'raise' (Expr ('from' Expr)?)? / ('global' / 'nonlocal') NAME (',' NAME)* / 'del' DelTarget (',' DelTarget)* ','? / 'assert' Expr (',' Expr)? / Import / TypeAlias / ExprStmt
Import <- 'import' Dotted ('as' NAME)? (',' Dotted ('as' NAME)?)* / 'from' (('.' / '...')* Dotted / ('.' / '...')+) 'import' ('*' / '(' Alias (',' Alias)* ','? ')' / Alias (',' Alias)* !',')
Dotted <- NAME ('.' NAME)*
Alias <- NAME ('as' NAME)?
TypeAlias <- "type" NAME TypeParams? '=' Expr
ExprStmt <- (Targets '=')+ (Yield / StarExprs) / Single AugOp (Yield / StarExprs) / (Single / '(' Single ')') ':' Expr ('=' (Yield / StarExprs))? / Yield / StarExprs
AugOp <- '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '>>=' / '<<=' / '**='
Targets <- Target (',' Target)* ','?
Target <- '*'? (TPrimary / NAME !Look / '(' Targets? ')' !Look / '[' Targets? ']' !Look)
Single <- TPrimary / NAME !Look / '(' Single ')' !Look
DelTarget <- TPrimary / NAME !Look / '(' (DelTarget (',' DelTarget)* ','?)? ')' / '[' (DelTarget (',' DelTarget)* ','?)? ']'
TPrimary <- Atom (Trailer &Look)* ('.' NAME / '[' Slices ']') !Look
Look <- '.' / '(' / '['
Compound <- Decorated / If / For / While / Try / With / 'async' (For / With / Def) / Def / Class
SoftCompound <- "match" Subject ':' NEWLINE INDENT Case+ DEDENT
Decorated <- ('@' NamedExpr NEWLINE)+ (Class / 'async'? Def)
Def <- 'def' NAME TypeParams? '(' Params? ')' ('->' Expr)? ':' Block
Params <- Param (',' Param)* ','?
Param <- '/' / '**' NAME (':' Expr)? / '*' (NAME (':' ('*'? Expr))?)? / NAME (':' Expr)? ('=' Expr)?
Class <- 'class' NAME TypeParams? ('(' Args? ')')? ':' Block
TypeParams <- '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam <- ('*' / '**')? NAME (':' Expr)? ('=' Expr)?
If <- 'if' NamedExpr ':' Block ('elif' NamedExpr ':' Block)* Else?
Else <- 'else' ':' Block
While <- 'while' NamedExpr ':' Block Else?
For <- 'for' Targets 'in' StarExprs ':' Block Else?
Try <- 'try' ':' Block (('except' '*'? (Expr ('as' NAME)?)? ':' Block)+ Else? ('finally' ':' Block)? / 'finally' ':' Block)
With <- 'with' ('(' WithItem (',' WithItem)* ','? ')' ':' / WithItem (',' WithItem)* ':') Block
WithItem <- Expr ('as' Target)?
Subject <- StarNamed (',' StarNamed)* ','?
Case <- "case" Patterns ('if' NamedExpr)? ':' Block
Patterns <- StarPattern (',' StarPattern)* ','?
StarPattern <- '*' NAME / AsPattern
AsPattern <- OrPattern ('as' NAME)?
OrPattern <- Pattern ('|' Pattern)*
Pattern <- '-'? NUM (('+' / '-') NUM)? / (STR / BYTES / FSTR)+ / 'None' / 'True' / 'False' / Dotted ('(' (PatternArg (',' PatternArg)* ','?)? ')')? / '(' Patterns? ')' / '[' Patterns? ']' / '{' (MapPattern (',' MapPattern)* ','?)? '}'
PatternArg <- NAME '=' AsPattern / AsPattern
MapPattern <- '**' NAME / Pattern ':' AsPattern
StarExprs <- StarExpr (',' StarExpr)* ','?
StarExpr <- '*' Arith / Expr
StarNamed <- '*' Arith / NamedExpr
NamedExpr <- NAME ':=' Expr / Expr !':='
Yield <- 'yield' ('from' Expr / StarExprs?)
Expr <- 'lambda' LambdaParams? ':' Expr / Disj ('if' Disj 'else' Expr)?
LambdaParams <- LambdaParam (',' LambdaParam)* ','?
LambdaParam <- '/' / '**' NAME / '*' NAME? / NAME ('=' Expr)?
Disj <- 'not'* Compare (('and' / 'or') 'not'* Compare)*
Compare <- Arith (('<' / '>' / '==' / '>=' / '<=' / '!=' / 'in' / 'not' 'in' / 'is' 'not'?) Arith)*
Arith <- Unary (('+' / '-' / '*' / '/' / '//' / '%' / '@' / '&' / '|' / '^' / '<<' / '>>') Unary)*
Unary <- ('+' / '-' / '~')* 'await'? Primary ('**' Unary)?
Primary <- Atom Trailer*
Trailer <- '.' NAME / '(' Args? ')' / '[' Slices ']'
Args <- Arg (',' Arg)* ','?
Arg <- '**' Expr / '*' Expr / NAME '=' Expr / NamedExpr Comp?
Comp <- ('async'? 'for' Targets 'in' Disj ('if' CompIf)*)+
CompIf <- NAME ':=' Expr / Disj
Slices <- Slice (',' Slice)* ','?
Slice <- Expr? ':' Expr? (':' Expr?)? / '*' Arith / NamedExpr
Atom <- NAME / NUM / (STR / FSTR)+ / BYTES+ / 'None' / 'True' / 'False' / '...' / '(' (Yield / StarNamed (Comp / (',' StarNamed)* ','?))? ')' / '[' (StarNamed (Comp / (',' StarNamed)* ','?))? ']' / Braces
Braces <- '{' (DictItem (Comp / (',' DictItem)* ','?))? '}' / '{' StarNamed (Comp / (',' StarNamed)* ','?) '}'
DictItem <- '**' Arith / Expr ':' Expr
"""

SCRIPT = """
File <- Item* EOF
Item <- Import / Export / Stmt
Import <- 'import' (STR / ImportType? (NAME (',' ('*' "as" NAME / NamedImports))? / '*' "as" NAME / NamedImports) "from" STR) With? @eos / ImportEquals
With <- 'with' '{' (PropName ':' STR (',' PropName ':' STR)* ','?)? '}'
NamedImports <- '{' (ImportSpec (',' ImportSpec)* ','?)? '}'
ImportSpec <- ImportType? ModuleName ("as" NAME)? / ImportType? ModuleName
ModuleName <- IdName / STR
Export <- 'export' (ExportTs / 'default' (Function / Decorators? Abstract? Class / 'async' Function / Interface / !'function' !'class' Assign @eos) / '*' ("as" ModuleName)? "from" STR With? @eos / ImportType? '{' (ExportSpec (',' ExportSpec)* ','?)? '}' ("from" STR With?)? @eos / Decl) / Decorators 'export' 'default'? Abstract? Class
ExportSpec <- ImportType? ModuleName ("as" ModuleName)?
Decl <- VarStmt / Function / Decorators? Abstract? Class / DeclTs
Stmt <- Block / VarStmt / DeclTs / Function / Decorators? Abstract? Class / ';' / If / For / While / Do / Jump / Switch / Try / Label / ExprStmt
Block <- '{' Stmt* '}'
VarStmt <- VarKind VarDecl (',' VarDecl)* @eos
VarKind <- 'var' / 'const' / "let" &(NAME / '[' / '{' / 'yield' / 'await')
VarDecl <- NAME Definite? TypeAnn? ('=' Assign)? / BindPattern TypeAnn? '=' Assign
If <- 'if' '(' Expression ')' Stmt ('else' Stmt)?
For <- 'for' 'await'? '(' (ForEach / ForInit? ';' Expression? ';' Expression?) ')' Stmt
ForEach <- ((VarKind / "let") (NAME / BindPattern) TypeAnn? / Left) ('in' Expression / "of" Assign)
ForInit <- VarKind VarDecl (',' VarDecl)* / Expression
While <- 'while' '(' Expression ')' Stmt / 'with' '(' Expression ')' Stmt
Do <- 'do' Stmt 'while' '(' Expression ')' ';'?
Jump <- 'return' (@same Expression)? @eos / ('break' / 'continue') (@same NAME)? @eos / 'throw' @same Expression @eos / 'debugger' @eos
Switch <- 'switch' '(' Expression ')' '{' (('case' Expression / 'default') ':' Stmt*)* '}'
Try <- 'try' Block ('catch' ('(' (NAME / BindPattern) TypeAnn? ')')? Block ('finally' Block)? / 'finally' Block)
Label <- NAME ':' Stmt
ExprStmt <- !'{' !'function' !'class' Expression @eos
Function <- Async? 'function' '*'? NAME? TypeParams? Params ReturnAnn? (Block / NoBody)
Async <- "async" @same
Params <- '(' (Param (',' Param)* (',' '...' RestParam / ','?) / '...' RestParam)? ')'
RestParam <- (NAME / BindPattern) TypeAnn?
Param <- Decorators? Access* ThisParam / Decorators? Access* (NAME / BindPattern) Optional? TypeAnn? ('=' Assign)?
BindPattern <- '[' (',' / BindItem (',' / &']') / '...' (NAME / BindPattern))* ']' / '{' (BindProp (',' BindProp)* (',' '...' NAME / ','?) / '...' NAME)? '}'
BindItem <- (NAME / BindPattern) ('=' Assign)?
BindProp <- PropName ':' BindItem / NAME ('=' Assign)?
Class <- 'class' (!Implements NAME)? TypeParams? ('extends' Left TypeArgs?)? Implements? '{' Member* '}'
Member <- ';' / 'STATIC' / "static" Block / IndexMember / Decorators? Modifiers MemberBody
Modifiers <- (Modifier &MemberStart)*
Modifier <- "static" / ModifierTs
MemberStart <- NAME / PRIV / STR / NUM / '[' / '*' / Keyword
MemberBody <- Accessor PropKey Params ReturnAnn? (Block / NoBody) / AsyncStar PropKey Optional? TypeParams? Params ReturnAnn? (Block / NoBody) / PropKey Definite? TypeAnn? ('=' Assign)? @eos
Accessor <- ("get" / "set") &MemberStart
AsyncStar <- ("async" @same &MemberStart)? '*'?
PropKey <- (PropName / PRIV) Optional?
PropName <- IdName / STR / NUM / '[' Assign ']'
IdName <- NAME / Keyword
Keyword <- 'break' / 'case' / 'catch' / 'class' / 'const' / 'continue' / 'debugger' / 'default' / 'delete' / 'do' / 'else' / 'export' / 'extends' / 'false' / 'finally' / 'for' / 'function' / 'if' / 'import' / 'in' / 'instanceof' / 'new' / 'null' / 'return' / 'super' / 'switch' / 'this' / 'throw' / 'true' / 'try' / 'typeof' / 'var' / 'void' / 'while' / 'with' / 'yield' / 'await' / 'enum'
Expression <- Assign (',' Assign)*
Assign <- Arrow / 'yield' (@same '*' Assign / @same Assign)? / Left AssignOp Assign / Conditional
AssignOp <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '>' '>' '>=' / '>' '>=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??='
Conditional <- Binary ('?' Assign ':' Assign)?
Binary <- (Unary / PRIV &'in') (BinaryOp Unary / AsOp)*
BinaryOp <- '||' / '&&' / '??' / '|' / '^' / '&' / '===' / '!==' / '==' / '!=' / '<=' / '>=' / '<<' / '<' / '>' '>' '>' / '>' '>' / '>' / 'instanceof' / 'in' / '**' / '*' / '/' / '%' / '+' / '-'
Unary <- ('delete' / 'void' / 'typeof' / '+' / '-' / '~' / '!' / '++' / '--' / 'await' / Cast)* Postfix
Postfix <- Left (@same ('++' / '--'))?
Left <- Primary Suffix*
Suffix <- '.' (IdName / PRIV) / '?.' (Args / '[' Expression ']' / IdName / PRIV / CallTypes) / '[' Expression ']' / Args / Template / NonNull / CallTypes
Args <- '(' (('...'? Assign) (',' '...'? Assign)* ','?)? ')'
Template <- TN / TH Expression (TM Expression)* TT
Primary <- Function / 'class' &ANY Class0 / NAME / NUM / STR / REGEX / Template / 'this' / 'super' &('(' / '.' / '[') / 'null' / 'true' / 'false' / 'new' ('.' "target" / New) / 'import' ('(' Assign (',' Assign)? ','? ')' / '.' "meta") / Array / Object / '(' Expression ')' / Decorators Class
Class0 <- (!Implements NAME)? TypeParams? ('extends' Left TypeArgs?)? Implements? '{' Member* '}'
New <- ('new' New / NewTarget) TypeArgs? Args?
NewTarget <- (NAME / 'this' / 'super' / 'class' Class0 / Function / '(' Expression ')' / Array / Object / 'import' '.' "meta" / 'null' / STR / NUM / Template) ('.' (IdName / PRIV) / '[' Expression ']' / NonNull)*
Array <- '[' (',' / '...'? Assign (',' / &']'))* ']'
Object <- '{' (Prop (',' Prop)* ','?)? '}'
Prop <- '...' Assign / Accessor PropName Params ReturnAnn? Block / AsyncStar PropName TypeParams? Params ReturnAnn? Block / PropName ':' Assign / NAME ('=' Assign)?
Arrow <- Async? (NAME / TypeParams? Params ReturnAnn?) @same '=>' (Block / !'{' Assign)
Decorators <- ('@' (NAME ('.' IdName)* (TypeArgs? Args)? / '(' Expression ')'))+
"""

JAVASCRIPT = SCRIPT + """
ImportType <- !EPS
ImportEquals <- !EPS
ExportTs <- !EPS
DeclTs <- !EPS
Interface <- !EPS
Abstract <- !EPS
Implements <- !EPS
IndexMember <- !EPS
ModifierTs <- !EPS
Access <- !EPS
ThisParam <- !EPS
Definite <- !EPS
Optional <- !EPS
TypeAnn <- !EPS
ReturnAnn <- !EPS
NoBody <- !EPS
TypeParams <- !EPS
TypeArgs <- !EPS
AsOp <- !EPS
Cast <- !EPS
NonNull <- !EPS
CallTypes <- !EPS
"""

TYPESCRIPT = SCRIPT + """
ImportType <- "type" &(NAME / '{' / '*') !("from" STR)
ImportEquals <- 'import' ImportType? NAME '=' ("require" '(' STR ')' / NAME ('.' IdName)*) @eos
ExportTs <- '=' Expression @eos / "as" "namespace" NAME @eos / 'import' NAME '=' Expression @eos
DeclTs <- Interface / TypeAlias / Enum / Namespace / "declare" @same (Function / VarStmt / Abstract? Class / DeclTs / "global" '{' Item* '}')
Interface <- "interface" @same NAME TypeParams? ('extends' Type (',' Type)*)? ObjectType
TypeAlias <- "type" @same NAME TypeParams? '=' Type @eos
Enum <- 'const'? 'enum' NAME '{' (EnumItem (',' EnumItem)* ','?)? '}'
EnumItem <- PropName ('=' Assign)?
Namespace <- ("namespace" / "module") @same (NAME ('.' NAME)* / STR) '{' Item* '}'
Abstract <- "abstract" @same
Implements <- "implements" Type (',' Type)*
IndexMember <- Modifiers '[' NAME ':' Type ']' TypeAnn @eos
ModifierTs <- "public" / "private" / "protected" / "readonly" / "abstract" / "override" / "declare" / "accessor"
Access <- ("public" / "private" / "protected" / "readonly" / "override") &(NAME / '{' / '[')
ThisParam <- 'this' TypeAnn
Definite <- '!'
Optional <- '?'
TypeAnn <- ':' Type
ReturnAnn <- ':' ("asserts" @same (NAME / 'this') ("is" Type)? !'.' / (NAME / 'this') "is" Type / Type)
NoBody <- @eos
TypeParams <- '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam <- ('const' / 'in' / "out")* NAME ('extends' Type)? ('=' Type)?
TypeArgs <- '<' Type (',' Type)* '>'
AsOp <- "as" @same ('const' / Type) / "satisfies" @same Type
Cast <- '<' Type '>' !'('
NonNull <- @same '!'
CallTypes <- TypeArgs &('(' / TN / TH)
Type <- FunctionType / ConditionalType
ConditionalType <- UnionType ('extends' UnionType '?' Type ':' Type)?
FunctionType <- Abstract? 'new'? TypeParams? Params '=>' ReturnType
ReturnType <- "asserts" @same (NAME / 'this') ("is" Type)? / (NAME / 'this') "is" Type / Type
UnionType <- ('|' / '&')? TypeOperand (('|' / '&') TypeOperand)*
TypeOperand <- ("keyof" / "unique" / "readonly") &(NAME / '(' / '[' / '{' / 'typeof' / 'this' / STR) TypeOperand / "infer" NAME ('extends' UnionType !'?')? / FunctionType / ArrayType
ArrayType <- TypeAtom (@same '[' Type? ']')*
TypeAtom <- 'typeof' (NAME / 'this' / 'import' '(' Type ')') ('.' (IdName / PRIV))* TypeArgs? / 'import' '(' Type ')' ('.' IdName)* TypeArgs? / NAME ('.' IdName)* (@same TypeArgs)? / 'this' / 'null' / 'void' / 'true' / 'false' / STR / '-'? NUM / TN / TH Type (TM Type)* TT / '(' Type ')' / TupleType / MappedType / ObjectType
TupleType <- '[' (TupleItem (',' TupleItem)* ','?)? ']'
TupleItem <- '...'? IdName '?'? ':' Type / '...'? Type '?'?
MappedType <- '{' (('+' / '-')? "readonly")? '[' NAME 'in' Type ("as" Type)? ']' (('+' / '-')? '?')? TypeAnn? ';'? '}'
ObjectType <- '{' (TypeMember (';' / ',' / @eos))* '}'
TypeMember <- 'new'? TypeParams? Params ReturnAnn? / ("readonly" &MemberStart)? '[' NAME ':' Type ']' TypeAnn / Accessor PropName Params ReturnAnn? / ("readonly" &MemberStart)? PropName '?'? (TypeParams? Params ReturnAnn? / TypeAnn)?
"""

GO = """
File <- 'package' NAME ';' (Import ';')* (Top ';')* EOF
Import <- 'import' (ImportSpec / '(' (ImportSpec (';' ImportSpec)* ';'?)? ')')
ImportSpec <- (NAME / '.')? STR
Top <- Decl / 'func' Receiver? NAME TypeParams? Signature Block?
Receiver <- Params
Decl <- 'const' (ConstSpec / '(' (ConstSpec (';' ConstSpec)* ';'?)? ')') / 'var' (VarSpec / '(' (VarSpec (';' VarSpec)* ';'?)? ')') / 'type' (TypeSpec / '(' (TypeSpec (';' TypeSpec)* ';'?)? ')')
ConstSpec <- Names (Type? '=' Exprs)?
VarSpec <- Names (Type ('=' Exprs)? / '=' Exprs)
TypeSpec <- NAME TypeParams Type / NAME '='? Type
Names <- NAME (',' NAME)*
TypeParams <- '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam <- Names Constraint
Constraint <- '~'? Type ('|' '~'? Type)*
Signature <- Params (Params / Type)?
Params <- '(' (ParamDecl (',' ParamDecl)* ','?)? ')'
ParamDecl <- NAME '...'? Type / '...'? Type
Type <- NAME ('.' NAME)? ('[' Type (',' Type)* ','? ']')? / '*' Type / '(' Type ')' / TypeLit
TypeLit <- '[' ('...' / Expr)? ']' Type / 'map' '[' Type ']' Type / 'chan' '<-'? Type / '<-' 'chan' Type / 'func' Signature / Struct / Interface
Struct <- 'struct' '{' (Field (';' Field)* ';'?)? '}'
Field <- (Names Type / '*'? NAME ('.' NAME)? ('[' Type (',' Type)* ']')?) STR?
Interface <- 'interface' '{' (Method (';' Method)* ';'?)? '}'
Method <- NAME Signature / Constraint
Block <- '{' Stmts '}'
Stmts <- (';' / Stmt (';' / &'}' / &'case' / &'default'))*
Stmt <- Decl / Block / If / For / Switch / Select / ('go' / 'defer') Primary / 'return' Exprs? / ('break' / 'continue' / 'goto') NAME? / 'fallthrough' / NAME ':' (Stmt / &';' / &'}') / Simple
Simple% <- Exprs% (':=' Exprs% / AssignOp Exprs% / '++' / '--' / '<-' Expr%)?
AssignOp <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^='
If <- 'if' (SimpleN? ';')? SimpleN Block ('else' (If / Block))?
For <- 'for' (((ExprsN (':=' / '='))? 'range' ExprN) / SimpleN? ';' ExprN? ';' SimpleN? / ExprN)? Block
Switch <- 'switch' (SimpleN? ';')? SimpleN? '{' (('case' (ExprOrType (',' ExprOrType)*) / 'default') ':' Stmts)* '}'
Select <- 'select' '{' (('case' Simple / 'default') ':' Stmts)* '}'
ExprOrType <- Expr / Type
Exprs% <- Expr% (',' Expr%)*
Expr% <- Unary% (BinaryOp Unary%)*
BinaryOp <- '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<<' / '>>' / '&^' / '<' / '>' / '+' / '-' / '*' / '/' / '%' / '&' / '|' / '^'
Unary% <- ('+' / '-' / '!' / '^' / '*' / '&' / '<-')* Primary%
Primary% <- Operand% Suffix*
Operand% <- NUM / STR / CHAR / 'func' Signature Block / @lit NAME ('.' NAME)? ('[' Type (',' Type)* ']')? LitBody / NAME / TypeLit (LitBody / '(' Expr ','? ')') / '(' (Expr / Type) ')'
Suffix <- '.' NAME / '.' '(' ('type' / Type) ')' / '[' (Expr? ':' Expr? (':' Expr)? / ExprOrType (',' Type)* ','?) ']' / '(' ((Arg (',' Arg)*) '...'? ','?)? ')'
Arg <- ExprOrType
LitBody <- '{' (Element (',' Element)* ','?)? '}'
Element <- (LitBody / Expr) (':' (LitBody / Expr))?
"""

RUST = """
File <- InnerAttr* Item* EOF
InnerAttr <- '#' '!' '[' Tree* ']'
Attr <- '#' '[' Tree* ']'
Tree <- '(' Tree* ')' / '[' Tree* ']' / '{' Tree* '}' / !')' !']' !'}' ANY
Item <- Attr* (Visibility? ItemBody / MacroItem)
Visibility <- 'pub' ('(' ('crate' / 'self' / 'super' / 'in' Path) ')')?
ItemBody <- 'use' UseTree ';' / 'mod' NAME (';' / '{' InnerAttr* Item* '}') / Fn / Struct / Enum / Union / Trait / Impl / 'type' NAME Generics? (':' Bounds?)? Where? ('=' Type)? Where? ';' / 'const' (NAME / "_") (':' Type)? ('=' Expr)? ';' / 'static' 'mut'? NAME ':' Type ('=' Expr)? ';' / 'extern' 'crate' (NAME / 'self') ('as' NAME)? ';' / 'unsafe'? 'extern' STR? '{' InnerAttr* Item* '}'
MacroItem <- "macro_rules" '!' NAME ('{' Tree* '}' / '(' Tree* ')' ';' / '[' Tree* ']' ';') / SimplePath '!' ('{' Tree* '}' / '(' Tree* ')' ';' / '[' Tree* ']' ';')
UseTree <- '::'? (SimplePath ('::' ('*' / '{' UseList? '}') / 'as' NAME)? / '*' / '{' UseList? '}')
UseList <- UseTree (',' UseTree)* ','?
SimplePath <- '::'? Segment ('::' Segment)*
Segment <- NAME / 'crate' / 'self' / 'super' / 'Self'
Fn <- ('const' / 'async' / 'unsafe' / 'extern' STR?)* 'fn' NAME Generics? '(' FnParams? ')' ('->' Type)? Where? (Block / ';')
FnParams <- FnParam (',' FnParam)* ','?
FnParam <- Attr* (('&' LIFE?)? 'mut'? 'self' (':' Type)? / '...' / PatternTop ':' (Type / '...'))
Struct <- 'struct' NAME Generics? (Where? '{' Fields? '}' / '(' TupleFields? ')' Where? ';' / Where? ';')
Union <- "union" NAME Generics? Where? '{' Fields? '}'
Fields <- StructField (',' StructField)* ','?
StructField <- Attr* Visibility? NAME ':' Type
TupleFields <- TupleField (',' TupleField)* ','?
TupleField <- Attr* Visibility? Type
Enum <- 'enum' NAME Generics? Where? '{' (Variant (',' Variant)* ','?)? '}'
Variant <- Attr* Visibility? NAME ('{' Fields? '}' / '(' TupleFields? ')')? ('=' Expr)?
Trait <- 'unsafe'? "auto"? 'trait' NAME Generics? (':' Bounds?)? Where? '{' InnerAttr* Item* '}'
Impl <- 'unsafe'? 'impl' (Generics &(Type))? '!'? Type ('for' Type)? Where? '{' InnerAttr* Item* '}'
Generics <- '<' (GenericParam (',' GenericParam)* ','?)? '>'
GenericParam <- Attr* (LIFE (':' (LIFE ('+' LIFE)* '+'?)?)? / 'const' NAME ':' Type ('=' (Block / '-'? Literal / NAME))? / NAME (':' Bounds?)? ('=' Type)?)
Where <- 'where' (WherePred (',' WherePred)* ','?)?
WherePred <- LIFE ':' Bounds? / ForLife? Type ':' Bounds?
Bounds <- Bound ('+' Bound)* '+'?
Bound <- LIFE / '(' Bound ')' / ('?' / '~' 'const' / 'const')? ForLife? TypePath
ForLife <- 'for' Generics
Type <- TypeNoPlus
TypeNoPlus <- '!' / '&&'? '&'? LIFE? 'mut'? RefTarget / '*' ('const' / 'mut') TypeNoPlus
RefTarget <- ('impl' / 'dyn') Bounds / '(' (Type (',' Type)* ','?)? ')' / '[' Type (';' Expr)? ']' / ForLife? FnPointer / "_" / ForLife? TypePath ('!' ('(' Tree* ')' / '[' Tree* ']' / '{' Tree* '}'))? / '!' / '&' TypeNoPlus / '&&' TypeNoPlus / '*' ('const' / 'mut') TypeNoPlus
FnPointer <- ('unsafe' / 'extern' STR?)* 'fn' '(' (FnPtrParam (',' FnPtrParam)* ','?)? ')' ('->' TypeNoPlus)?
FnPtrParam <- Attr* (NAME ':')? (Type / '...')
TypePath <- Qualified ('::' TypeSegment)+ / '::'? TypeSegment ('::' TypeSegment)*
TypeSegment <- Segment ('::'? GenericArgs / '(' (Type (',' Type)* ','?)? ')' ('->' TypeNoPlus)?)?
Qualified <- '<' Type ('as' TypePath)? '>'
GenericArgs <- '<' (GenericArg (',' GenericArg)* ','?)? '>'
GenericArg <- LIFE / NAME GenericArgs? ('=' Type / ':' Bounds) / Type / Block / '-'? Literal
Path <- Qualified ('::' PathSegment)+ / '::'? PathSegment ('::' PathSegment)*
PathSegment <- Segment ('::' GenericArgs)?
Literal <- NUM / STR / CHAR / 'true' / 'false'
PatternTop <- '|'? Pattern
PatternOr <- '|'? Pattern ('|' Pattern)*
Pattern <- '-'? NUM RangeTail? / Literal RangeTail? / ('..=' / '..') ('-'? Literal / Path)? / ('&' / '&&') 'mut'? Pattern / '(' PatternList? ')' / '[' PatternList? ']' / 'ref'? 'mut'? NAME !('::' / '(' / '{' / '!') ('@' Pattern)? RangeTail? / Path ('{' PatternFields? '}' / '(' PatternList? ')' / '!' ('(' Tree* ')' / '[' Tree* ']' / '{' Tree* '}') / RangeTail)? / 'const' Block
RangeTail <- ('..=' / '...' / '..') ('-'? Literal / Path)?
PatternList <- PatternOr (',' PatternOr)* ','?
PatternFields <- PatternField (',' PatternField)* ','?
PatternField <- Attr* ('..' / (NAME / NUM) ':' PatternOr / 'ref'? 'mut'? NAME)
Block <- '{' InnerAttr* Stmt* '}'
Stmt <- ';' / Attr* Let / ItemStmt / Attr* BlockLike !('.' / '?') ';'? / Attr* Expr (';' / &'}')
ItemStmt <- Attr* Visibility? &('use' / 'mod' / 'fn' / 'struct' / 'enum' / 'trait' / 'impl' / 'type' / 'static' / 'extern' / 'const' / 'async' / 'unsafe' / "union" / "macro_rules") ItemBody / Attr* "macro_rules" '!' NAME ('{' Tree* '}' / '(' Tree* ')' ';')
Let <- 'let' PatternOr (':' Type)? ('=' Expr ('else' Block)?)? ';'
BlockLike <- (LIFE ':')? (If / Match / 'loop' Block / 'while' Cond Block / 'for' PatternOr 'in' ExprN Block / 'unsafe' Block / Block) / 'async' 'move'? Block / MacroPath '!' '{' Tree* '}'
MacroPath <- SimplePath
If <- 'if' Cond Block ('else' (If / Block))?
Cond <- CondPart ('&&' CondPart)*
CondPart <- 'let' PatternOr '=' LetExprN / ExprN
LetExprN <- UnaryN (LazyFreeOp UnaryN / 'as' TypeNoPlus)*
Match <- 'match' ExprN '{' InnerAttr* Arm* '}'
Arm <- Attr* PatternOr ('if' Cond)? '=>' (BlockLike !('.' / '?') ','? / Expr (',' / &'}'))
Expr% <- Attr* Assign%
Assign% <- Jump% / Closure% / Range% (AssignOp Assign%)?
AssignOp <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>='
Jump% <- 'return' Expr%? / 'break' LIFE? Expr%? / 'continue' LIFE?
Closure% <- 'static'? 'async'? 'move'? ('||' / '|' (ClosureParam (',' ClosureParam)* ','?)? '|') ('->' TypeNoPlus Block / Expr%)
ClosureParam <- Attr* Pattern (':' Type)?
Range% <- Binary% (('..=' / '..') Binary%?)? / ('..=' / '..') Binary%?
Binary% <- Unary% (BinaryOp (Unary% / Closure% / Jump%) / 'as' TypeNoPlus)*
BinaryOp <- '||' / '&&' / LazyFreeOp
LazyFreeOp <- '==' / '!=' / '<=' / '>=' / '<<' / '>' '>' / '<' / '>' / '+' / '-' / '*' / '/' / '%' / '^' / '&' / '|'
Unary% <- ('-' / '!' / '*' / '&&' &ANY / '&' ("raw" ('const' / 'mut' &'mut'))? )* 'mut'? Postfix%
Postfix% <- Primary% ('?' / '.' 'await' / '.' NAME ('::' GenericArgs)? / '.' NUM / '(' Exprs? ')' / '[' Expr ']')*
Exprs <- Expr (',' Expr)* ','?
Primary% <- BlockLike / Literal / MacroPath '!' ('(' Tree* ')' / '[' Tree* ']' / '{' Tree* '}') / @lit Path '{' FieldInits? '}' / Path / '(' Exprs? ')' / '[' (Expr (';' Expr / (',' Expr)* ','?))? ']' / "_" / 'const' Block
FieldInits <- '..' Expr / FieldInit (',' FieldInit)* (',' '..' Expr / ','?)
FieldInit <- Attr* ((NAME / NUM) ':' Expr / NAME)
"""


def _eos(p, kinds, words, breaks):
    """End of a script statement: a semicolon, or where one is inserted."""
    if kinds[p] == ";":
        return p + 1
    return p if breaks[p] or kinds[p] in ("}", "EOF") else -1


def _same(p, kinds, words, breaks):
    return -1 if breaks[p] else p


@cache
def grammar(language: str) -> Grammar:
    text = {"python": PYTHON, "javascript": JAVASCRIPT, "typescript": TYPESCRIPT, "go": GO, "rust": RUST}[language]
    return Grammar(text, "File", {"eos": _eos, "same": _same})
