"""Schemas of nested values."""

from __future__ import annotations

MEDIA = "struct<kind:string,url:string,alt:string>"
BLOCK = f"struct<type:string,level:int,text:string,style:string,items:array<string>,language:string,url:string,alt:string,caption:string,post_id:string,author_handle:string,display_name:string,published_at:string,media:array<{MEDIA}>>"
BLOCKS = f"array<{BLOCK}>"
COMPACT = "array<struct<t:string,l:int,x:string,o:boolean,i:array<string>,lang:string>>"
UNITS = "array<struct<paragraph:int,anchor:int,chars:int,font:string,paragraph_start:boolean,paragraph_end:boolean,clause_pause:boolean,sentence_pause:boolean,display:string>>"
FEED = "struct<kind:string,title:string,entries:array<struct<entry_key:string,url:string,title:string,author:string,summary:string,published:string>>>"
